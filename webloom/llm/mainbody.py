"""The main body of a saved page, by composite text density over the tree of its lines.

A saved text has no markup left, so the tree is the page's own layout: the page, below it its blocks (runs of lines of
one nature), below those the lines, and in a line the pieces it is made of. Each line's link characters are told from
its structure (a row of short items between separators, a sentence followed by controls, a short call without an end
that asks to subscribe, sign in, share or jump), from its being repeated beside many different contents of a host, and
from the wording of page furniture in six languages. The composite density of a node divides its characters by its tags
and takes off by its links; the densities of a node's children are summed, and the block with the greatest sum is the
body. The density of the page, the last step of the path from that block to the root, is the threshold: blocks below it
are furniture, whatever their lines are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection, Iterator
from functools import cache, lru_cache
from hashlib import blake2b

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import checkpoint

# Entries of site menus in six languages.
MENU = (
    "Home|News|Archive|About us|Events|Jobs|Authors|Reviews|Gallery|Downloads|Forum|Guides|Contact|Shop|Books|Press|Podcasts|Subscribe|Topics|Pricing|Gift cards|Our team|Help centre|Store locator|Imprint|Privacy|Sitemap|RSS|"
    "Terms of use|Privacy policy|Accessibility|Blog|FAQ|Login|Search|Menu|Products|Services|"
    "Inicio|Noticias|Archivo|Quiénes somos|Autores|Guías|Temas|Libros|Contacto|Tienda|Foro|Ayuda|Aviso legal|Privacidad|Mapa del sitio|Eventos|"
    "Accueil|Actualités|Archives|À propos|Auteurs|Livres|Sujets|Boutique|Aide|Mentions légales|Confidentialité|Plan du site|"
    "Startseite|Aktuelles|Archiv|Über uns|Autoren|Ratgeber|Themen|Bücher|Kontakt|Laden|Hilfe|Impressum|Datenschutz|AGB|"
    "Главная|Новости|Архив|О нас|Авторы|Темы|Книги|Контакты|Магазин|Форум|Помощь|Статьи|Условия|Конфиденциальность|Карта сайта|Советы|Справочник|"
    "首页|新闻|关于我们|作者|专题|图书|联系|商店|论坛|帮助|指南|归档|存档|档案|使用条款|隐私政策|网站地图"
)
# Headings above lists of other pages.
LIST_HEADINGS = (
    r"You may also like|Related articles|Recently viewed|Popular this week|Readers also opened|Most read|Latest posts|More from [\w.'-]+|"
    r"Artículos relacionados|También te puede interesar|Lo más leído|Más de [\w.'-]+|Articles liés|À lire aussi|Les plus lus|Plus de [\w.'-]+|"
    r"Das könnte Sie auch interessieren|Ähnliche Beiträge|Meistgelesen|Mehr von [\w.'-]+|Читайте также|Популярное|Похожие статьи|Ещё от [\w.'-]+|"
    r"猜你喜欢|相关文章|热门排行|更多来自 ?\S+"
)
NAME = r"[\w.'’&-]+(?: [\w.'’&-]+){0,3}?"
# The wording of page furniture in six languages, as patterns; names and numbers vary.
PHRASES = [
    # jump links and menus
    r"(?:Skip|Jump) to (?:the )?(?:main )?(?:content|navigation)", r"Saltar al contenido", r"Aller au contenu", r"Zum Inhalt springen", r"Перейти к содержанию", r"跳到内容",
    r"Menu Close", r"Open menu", r"Abrir menú", r"Ouvrir le menu", r"Menü öffnen", r"Меню", r"打开菜单", r"Back to top ?↑?", r"Volver arriba", r"Haut de page", r"Nach oben", r"Наверх", r"返回顶部",
    # search, sign-in, basket, counters
    r"Search this site Go", r"Buscar", r"Rechercher", r"Suche Los", r"Поиск", r"搜索", r"Sign in ?\| ?Register", r"Entrar ?\| ?Registrarse", r"Connexion ?\| ?Inscription", r"Anmelden ?\| ?Registrieren", r"Вход ?\| ?Регистрация", r"登录 ?\| ?注册",
    r"Logged out - sign in to save pages", r"(?:Basket|Cesta|Warenkorb|Panier|Корзина) ?\(\d+\)(?: [£$€]?\d[\d.,]* ?[€₽£$]?)?", r"购物车 ?[(（]\d+[)）](?: ?[¥£$€]\d[\d.,]*)?",
    r"\d+ readers online", r"\d+ lectores en línea", r"\d+ lecteurs en ligne", r"\d+ Leser online", r"\d+ читател\w+ на сайте", r"\d+人在线",
    r"Language: English(?: (?-i:[A-Z]{3}))+", r"Today is day \d+ - [\w'-]+, -?\d+ ?°C",
    # cookies, privacy, scripts
    r"[\w.'-]+ uses cookies to improve your visit\. Accept all Reject Manage settings", r"By continuing to browse [\w.'-]+ you consent to our use of cookies\. Got it", r"Cookie settings: strictly necessary cookies are always on\. Confirm",
    r"This site stores small files to remember your choices\. Learn more Dismiss", r"Your choices about tracking: Necessary Statistics Marketing Save preferences", r"We value your privacy\. We and our \d+ partners store information on your device\. Agree Options",
    r"To keep [\w.'-]+ free we and \d+ vendors ask for permission to process data\. Accept & close", r"Al seguir navegando aceptas el uso de cookies\. Entendido", r"[\w.'-]+ utiliza cookies propias y de \d+ socios\. Aceptar Rechazar Configurar",
    r"[\w.'-]+ utilise des cookies avec \d+ partenaires\. Tout accepter Refuser Paramétrer", r"En poursuivant votre visite, vous acceptez les cookies\. J'ai compris", r"[\w.'-]+ verwendet Cookies\. Alle akzeptieren Ablehnen Einstellungen",
    r"Wir schätzen Ihre Privatsphäre: \d+ Partner speichern Daten auf Ihrem Gerät\. Zustimmen", r"Сайт [\w.'-]+ использует файлы cookie\. Принять Отклонить", r"Продолжая просмотр, вы соглашаетесь на обработку данных\. Хорошо",
    r"[A-Za-z.'-]+使用Cookie改善体验。全部接受 拒绝 设置", r"继续浏览即表示您同意我们使用Cookie。知道了",
    # adverts, letters, comments
    r"Advertisement", r"Story continues below", r"Sponsored: .{3,120}?\(advert\)", r"Publicidad", r"Publicité", r"Anzeige", r"Реклама", r"广告", r"Get our weekly letter\. Enter your e-mail Sign up", r"Suscríbete al boletín: tu correo Enviar", r"Recevez notre lettre ?: votre adresse OK",
    r"Newsletter abonnieren: E-Mail eingeben Absenden", r"Подпишитесь на рассылку(?:: ваш e-mail| Отправить|: ваша почта Отправить)?", r"订阅我们的周报(?:[:：]? ?\S{0,12})?", r"Leave a reply - you must be logged in to comment", r"Was this helpful\? Yes No", r"War das hilfreich\? Ja Nein",
    # shares
    r"\d+ shares - Like - Save", r"Share Tweet Pin Print", r"Share this page: Mail Print Copy link", r"Compartir Imprimir Guardar", r"\d+ veces compartido", r"Partager Imprimer Enregistrer", r"\d+ partages", r"Teilen Drucken Merken", r"\d+ Mal geteilt", r"Поделиться Печать(?: \w+)?", r"\d+ репост\w*", r"分享 打印 收藏", r"\d+次转发",
    # tags and paging: the rest of the line belongs to them
    r"Filed under [\w'-]+(?: ?/ ?[\w'-]+)*", r"(?:Topics|Tags|Etiquetas|Schlagwörter|Метки|Mots-clés|标签) ?[:：] ?[\w'-]+(?: ?[·,、，|] ?[\w'-]+)*", r"Page \d+ of \d+(?: Next »)?", r"Página \d+ de \d+(?: Siguiente »)?", r"Seite \d+ von \d+(?: Weiter »)?", r"Page \d+ sur \d+(?: Suivant\w* »)?", r"Страница \d+ из \d+(?: Далее »)?", r"第 ?\d+ ?页(?:，?共 ?\d+ ?页)?(?: 下一页 ?»?)?",
    # footers
    r"© ?\d{4} [\w.'-]+(?:\. (?:All rights reserved|Todos los derechos reservados|Tous droits réservés|Alle Rechte vorbehalten|Все права защищены)\.| ?版权所有)", r"Copyright \d{4} by [\w.'-]+ and its contributors", r"Prices include tax unless stated\. [\w.'-]+ is not responsible for linked sites\.",
    r"Built by [\w.'-]+ Web Works", r"Follow [\w.'-]+ on our feeds", r"Call us: [\d-]+", r"[\w.'-]+ Ltd, \d+ [\w.'-]+ Street, [\w.'-]+", r"[\w.'-]+ S\. L\., calle [\w.'-]+ \d+, [\w.'-]+", r"[\w.'-]+ SARL, \d+ rue [\w.'-]+, [\w.'-]+", r"[\w.'-]+ GmbH, [\w.'-]+ \d+, [\w.'-]+", r"ООО «?[\w.'-]+»?, ул\. [\w.'-]+,? (?:д\. )?\d+, [\w.'-]+", r"[\w.'-]+有限公司，?\S{0,24}号?",
    r"Terms of use \| Privacy policy \| Imprint \| Accessibility", r"Imprint Privacy Sitemap RSS", r"Aviso legal \| Privacidad \| Mapa del sitio", r"Mentions légales \| Confidentialité \| Plan du site", r"Impressum \| Datenschutz \| AGB", r"Условия \| Конфиденциальность \| Карта сайта", r"使用条款 \| 隐私政策 \| 网站地图",
]
# What introduces one other page in a line of its own.
TEASERS = r"(?:Read also|Don't miss|More|Lea también|Lire aussi|À lire aussi|Lesen Sie auch|Читайте также|延伸阅读) ?[:：] ?"
PAGERS = r"(?:Previous|Anterior|Précédent|Zurück|Назад|上一篇) ?[:：] ?.{2,110}? ?\| ?(?:Next|Siguiente|Suivant|Weiter|Далее|下一篇) ?[:：] ?"
# Notices about scripts as they stand above a page's real content.
SCRIPT_NOTICES = [
    r"Some features need scripts; your browser has them turned off\.", r"Please enable JavaScript for the best experience on [\w.'-]+\.", r"Activa JavaScript para ver todas las funciones\.", r"Activez JavaScript pour profiter du site\.",
    r"Bitte aktivieren Sie JavaScript, um alle Funktionen zu nutzen\.", r"Включите JavaScript для полной версии\.", r"请启用JavaScript以获得完整功能。",
]

# Stems of what furniture asks for, and the words of its controls, in six languages.
ASKS = (
    r"cookies?|subscribe|sign (?:in|up)|log ?(?:in|out)|logged (?:in|out)|unsubscribe|privacy|consent|e-?mail address|all rights reserved|follow us|share this|add to (?:basket|cart)|download our app|advertis\w+|sponsored|"
    r"suscr[ií]b\w+|iniciar sesión|regístr\w+|privacidad|derechos reservados|síguenos|compártelo|publicidad|abonn\w+|se connecter|inscri\w+|confidentialité|droits réservés|suivez-nous|partagez|publicité|"
    r"anmelden|registrier\w+|datenschutz\w*|einwilligung|rechte vorbehalten|folgen sie uns|werbung|подпи(?:сыв|ш|с)\w+|войти|регистрац\w+|конфиденциальност\w+|права защищены|поделит\w+|реклам\w+|订阅|登录|注册|隐私|版权所有|关注我们|广告"
)
CONTROLS = (
    r"accept|agree|allow|reject|decline|dismiss|confirm|close|ok(?:ay)?|got it|i understand|no,? thanks|not now|later|manage|settings|options|preferences|customi[sz]e|learn more|more info(?:rmation)?|save|go|submit|send|sign up|join|subscribe|yes|no|"
    r"aceptar|rechazar|configurar|cerrar|entendido|de acuerdo|enviar|accepter|refuser|paramétrer|fermer|compris|d'accord|envoyer|akzeptieren|ablehnen|einstellungen|schließen|verstanden|zustimmen|absenden|принять|отклонить|закрыть|понятно|согласен|хорошо|отправить|接受|拒绝|设置|关闭|知道了|同意|发送"
)
JUMPS = r"(?:skip|jump|go|scroll)(?: \w+){0,2} to(?: the| main){0,2} (?:content|navigation|menu|article|text|search|footer|top|comments)|(?:ir|saltar|pasar) al? (?:contenido|menú|texto)|(?:aller|passer) (?:au|directement au) (?:contenu|menu|texte)|(?:zum|direkt zum|weiter zum) (?:inhalt|menü|artikel)|(?:перейти|к) (?:к )?(?:содержанию|меню|тексту)|跳[到至](?:主要)?(?:内容|正文|菜单)"

SEPARATOR = r"(?: ?[|·/»>•] ?|\s+)"
MENU = "|".join(sorted(MENU.split("|"), key=len, reverse=True))
#: What lines of a menu, and headings above lists, begin with; most lines begin with neither.
MENU_HEADS, LIST_HEADS = ({x[:2] for x in words.split("|")} for words in (MENU, LIST_HEADINGS))
LEFT, RIGHT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
PATTERNS = [regex.compile(f"{LEFT}(?:{p}){RIGHT}", regex.I) for p in PHRASES + SCRIPT_NOTICES]
MENU_LINE = regex.compile(rf"(?:{MENU})(?:{SEPARATOR}(?:{MENU}))*")
MENU_RUN = regex.compile(rf"{LEFT}(?:{MENU})(?:{SEPARATOR}(?:{MENU})){{2,}}{RIGHT}")
HEADING = regex.compile(rf"(?:{LIST_HEADINGS}) ?:?")
HEADING_IN = regex.compile(rf"{LEFT}(?:{LIST_HEADINGS}){RIGHT}(?! ?[:：])")
TEASER_IN = regex.compile(rf"{LEFT}(?:{TEASERS}|{PAGERS})", regex.I)
TEASER = regex.compile(rf"(?:{TEASERS})(?!.*[.。!?]$).{{3,}}|(?:{PAGERS}).+", regex.I)
CRUMB = regex.compile(rf"(?:{MENU})(?: ?[>»/] ?(?:{MENU}))* ?[>»/] ?.+")
CRUMB_HEAD = regex.compile(rf"{LEFT}(?:Home|Inicio|Accueil|Startseite|Главная|首页)(?: ?[>»/] ?(?:{MENU}))* ?[>»/] ?")
SENTENCE = regex.compile(r"\p{Ll}[.!?][”»’\")]* \p{Lu}|[。！？].")
ENTRY_END = regex.compile(r"[.!?。！？;；:：]$")
HAN = re.compile("[㐀-鿿豈-﫿]")
NOTICE = regex.compile("|".join(SCRIPT_NOTICES), regex.I)
ASKING = regex.compile(rf"(?<![\p{{L}}])(?:{ASKS})(?![\p{{L}}])", regex.I)
JUMP = regex.compile(rf"(?:{JUMPS})", regex.I)
#: A sentence, and after its end nothing but controls.
CONTROLLED = regex.compile(rf".*[.!?。！？:：…] *(?:(?:{CONTROLS})(?: (?:all|cookies|and close|& close|todo|tout|alle|все|全部))?[ /|,·&-]*)+[.!]?", regex.I)
ITEM_SEPARATOR = re.compile(r" *[|·•»›>] *| +/ +")
ITEM_MARKS = ("|", "·", "•", "»", "›", ">", " /")
ITEM = regex.compile(r"[\p{L}&' -]{2,30}")
SENTENCE_END = regex.compile(r"[.!?。！？…][”»’\")]*$")
#: Words of a call; more are a text. The marks of asking stems and of jump links among the hits.
CALL_WORDS, ASKED, JUMPED = 14, -1, -2
NUMBERED = re.compile(r"\d\.$")
HOST = re.compile(r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
#: A line is repeated if it stands beside this many different contents of its host, and this share of them.
REPEATED, REPEATED_SHARE = 10, 0.1
#: Up to this many repeated lines are broadcast; more are joined to the pages by host.
BROADCAST_LINES = 1_000_000


def _needles(pattern: str) -> set[str]:
    """Strings of which a match of the pattern holds at least one: its longest literal, or one of each branch."""
    parser, kinds = re._parser, re._constants

    def of(items) -> set[str]:
        choices: list[set[str]] = []
        run = ""
        for kind, value in [*items, (None, None)]:
            if kind is kinds.LITERAL:
                run += chr(value)
                continue
            choices.append({run})
            run = ""
            if kind is kinds.SUBPATTERN:
                choices.append(of(value[3]))
            elif kind is kinds.BRANCH:
                choices.append(set().union(*map(of, value[1])))
        return max(choices, key=lambda c: min(map(len, c)))

    found = {x.lower() for x in of(parser.parse(pattern))}
    assert all(found), pattern
    return found


@cache
def _automaton() -> ahocorasick.Automaton:
    """Finds in one pass which patterns a line can match at all; most prose holds the literals of none."""
    words: dict[str, list[int]] = {}
    for i, p in enumerate(PHRASES + SCRIPT_NOTICES):
        for w in _needles(p):
            words.setdefault(w, []).append(i)
    for p in regex.split(r"\|(?![^(]*\))", ASKS):
        for w in _needles(p):
            words.setdefault(w, []).append(ASKED)
    for w in _needles(JUMPS):
        words.setdefault(w, []).append(JUMPED)
    out = ahocorasick.Automaton()
    for w, which in words.items():
        out.add_word(w, which)
    out.make_automaton()
    return out


@lru_cache(maxsize=1 << 14)
def _hits(text: str) -> frozenset[int]:
    """The patterns that a text can match at all."""
    found: set[int] = set()
    for _, hits in _automaton().iter(text.lower()):
        found.update(hits)
    return frozenset(found)


def phrases(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the furniture phrases of a text, leftmost and longest first, without overlap."""
    which = _hits(text)
    if not which:
        return
    end = 0
    for start, stop in sorted((m.span() for i in which if i >= 0 for m in PATTERNS[i].finditer(text)), key=lambda x: (x[0], -x[1])):
        if start >= end:
            yield start, stop
            end = stop


def _cells(line: str) -> int:
    return sum(1 for x in ITEM_SEPARATOR.split(line) if x) if ITEM_SEPARATOR.search(line) else 0


def items(line: str) -> int:
    """The number of short items without figures that a line lists between separators, else 0."""
    if not any(map(line.__contains__, ITEM_MARKS)):
        return 0
    parts = [x for x in ITEM_SEPARATOR.split(line) if x]
    return len(parts) if len(parts) >= 3 and all(ITEM.fullmatch(x) and x.count(" ") < 4 for x in parts) else 0


def structural(line: str) -> bool:
    """Whether a line is a call or a notice with controls by its make, whatever site it stands on."""
    hits = _hits(line)
    if not hits:
        return False
    if JUMPED in hits and JUMP.fullmatch(line):
        return True
    if ASKED not in hits or not ASKING.search(line):
        return False
    return not SENTENCE_END.search(line) and line.count(" ") < CALL_WORDS or bool(CONTROLLED.fullmatch(line))


@lru_cache(maxsize=1 << 16)
def link_chars(line: str) -> tuple[int, int]:
    """(characters, pieces) of a stripped line that are page furniture by its wording."""
    if line[:2] in MENU_HEADS and MENU_LINE.fullmatch(line):
        return len(line), 1 + sum(line.count(c) for c in "|·/»> ")
    if line[:2] in LIST_HEADS and HEADING.fullmatch(line) or (":" in line or "：" in line) and TEASER.fullmatch(line):
        return len(line), 1
    if (">" in line or "»" in line or "/" in line) and CRUMB.fullmatch(line):
        return len(line), 2 + sum(line.count(c) for c in "/»>")
    chars = pieces = 0
    rest = []
    end = 0
    for start, stop in phrases(line):
        chars += stop - start
        pieces += 1
        rest.append(line[end:start])
        end = stop
    if chars:
        rest.append(line[end:])
        for r in rest:
            r = r.strip(" |·-–—")
            if r and MENU_LINE.fullmatch(r):
                chars += len(r)
                pieces += 1
    return chars, pieces


def density(chars: float, tags: float, links: float, link_tags: float, page_chars: float, page_links: float) -> float:
    """Composite text density of a node; zero counts of links, plain characters and tags count as one."""
    if chars <= 0:
        return 0.0
    base = page_links / (page_chars if page_chars > 1.0 else 1.0) * chars + math.e
    if links:
        plain = chars - links
        base += chars / (plain if plain > 1.0 else 1.0) * links
    ratio = chars / (links if links > 1.0 else 1.0) * (tags if tags > 1.0 else 1.0) / (link_tags if link_tags > 1.0 else 1.0)
    if ratio <= 1.0:
        return 0.0
    return chars / (tags if tags > 1.0 else 1.0) * math.log(ratio) / max(math.log(math.log(base)), 0.05)


def _same(a: str, b: str) -> bool:
    return bool(a) and bool(b) and (a == b or len(a) > 8 and (b.startswith(a) or b.endswith(a)))


def furniture(lines: list[str], title: str | None = None, own: bool = True, repeated: Collection[int] = ()) -> list[bool]:
    """For each line of a page, whether it is page furniture; blank lines are not.

    ``own`` tells that these are the page's own lines and not cut from a single one, in which lists are one part.
    ``repeated`` are the places of lines known to be repeated over the host's pages; they are links, but a page of
    nothing else keeps them as its message.
    """
    stripped = [x.strip() for x in lines]
    n = len(stripped)
    links, tags = [0.0] * n, [1.0] * n
    title = (title or "").strip()
    listing = False
    by_count: set[int] = set()
    for i, line in enumerate(stripped):
        if not line:
            continue
        c, p = link_chars(line)
        if 2 * c < len(line):
            above, below = stripped[i - 1] if i else "", stripped[i + 1] if i + 1 < n else ""
            if structural(line) and not below[:1].islower():
                c, p = len(line), max(1, p)
            elif (k := items(line)) and k not in (_cells(above), _cells(below)):
                c, p = len(line), k  # a row of items that is no row of a table
        if c >= 0.7 * len(line):
            listing = listing and not MENU_LINE.fullmatch(line) or bool(HEADING.fullmatch(line))
        elif listing:
            if own and len(line) > 130 or SENTENCE.search(line) or ENTRY_END.search(line) and not NUMBERED.search(line) or _same(line, title):
                listing = False
            else:
                c, p = len(line), 1
        if i in repeated and c < 0.5 * len(line) and not _same(line, title):
            c, p = len(line), 1
            by_count.add(i)
        links[i], tags[i] = float(c), float(max(1, p))
    weight = [float(len(x)) if x.isascii() else len(x) + 1.5 * len(HAN.findall(x)) for x in stripped]
    links = [l * w / max(1, len(x)) for l, w, x in zip(links, weight, stripped)]
    page_chars, page_links, page_tags = sum(weight), sum(links), sum(t for t, x in zip(tags, stripped) if x)
    link_tags = sum(t for t, l in zip(tags, links) if l)
    threshold = density(page_chars, page_tags, page_links, link_tags, page_chars, page_links)
    # the children of the page: runs of lines of one nature
    blocks: list[list[int]] = []
    for i, line in enumerate(stripped):
        if line:
            if blocks and (links[i] >= 0.5 * weight[i]) == (links[blocks[-1][0]] >= 0.5 * weight[blocks[-1][0]]):
                blocks[-1].append(i)
            else:
                blocks.append([i])
    sums, own = [], []
    for at in blocks:
        total = w = t = l = lt = 0.0
        for i in at:
            linked = tags[i] if links[i] else 0.0
            total += density(weight[i], tags[i], links[i], linked, page_chars, page_links)
            w, t, l, lt = w + weight[i], t + tags[i], l + links[i], lt + linked
        sums.append(total)
        own.append(density(w, t, l, lt, page_chars, page_links))
    body = max(range(len(blocks)), key=sums.__getitem__, default=0)
    out = [False] * n
    for k, at in enumerate(blocks):
        if not (own[k] >= threshold and own[k] > 0 or k == body and sums[k] > 0):
            for i in at:
                out[i] = not _same(stripped[i], title)
    if all(o for o, x in zip(out, stripped) if x):  # nothing else: a notice about scripts is then the message itself
        out = [o and i not in by_count and not NOTICE.fullmatch(x) for i, (o, x) in enumerate(zip(out, stripped))]
    return out


def page_lines(text: str, title: str | None = None) -> tuple[list[str], bool]:
    """The lines of a text and whether they are its own; a text of one line is cut where furniture begins and ends."""
    lines = text.split("\n")
    if len(lines) > 1:
        return [x.rstrip("\r") for x in lines], True
    body = text.strip()
    title = _headline(body, title)
    taken = [*phrases(body)]
    plain = body
    for start, end in taken:  # what is left of the body keeps its places
        plain = plain[:start] + "\n" * (end - start) + plain[end:]
    for m in CRUMB_HEAD.finditer(plain):
        end = m.end() + len(title) if title and plain.startswith(title, m.end()) else m.end()
        taken.append((m.start(), end))
    for start, end in taken:
        plain = plain[:start] + "\n" * (end - start) + plain[end:]
    taken += (m.span() for m in MENU_RUN.finditer(plain))
    cuts = {x for span in taken for x in span}
    parts = _cut(body, cuts)
    out = []
    for part in parts:
        m = HEADING_IN.search(part)
        if m and not SENTENCE.search(part, m.end()):  # a list of other pages runs up to the next furniture
            out += [part[: m.start()], part[m.start() : m.end()], part[m.end() :].strip()]
        else:
            teaser = TEASER_IN.search(part)
            if teaser and not SENTENCE.search(part, teaser.end()) and not ENTRY_END.search(part):
                out += [part[: teaser.start()], part[teaser.start() :]]
            else:
                out.append(part)
    return [x for x in (y.strip(" |") for y in out) if x], False


def _headline(body: str, title: str | None) -> str:
    """The page's headline as it stands in the body, from a title that may carry the site's name."""
    if not title or not title.strip():
        return ""
    title = title.strip()
    for candidate in [title, *regex.split(r" [|–—-] ", title)]:
        if len(candidate) > 5 and body.count(candidate) > 1:
            return candidate
    return ""


def _cut(body: str, cuts: set[int]) -> list[str]:
    places = sorted(cuts | {0, len(body)})
    return [body[a:b] for a, b in zip(places, places[1:])]


def main_content(text: str | None, title: str | None = None) -> list[str]:
    """The non-blank lines of the main body, stripped, in order; nothing for null and blank texts."""
    if not text or text.isspace():
        return []
    lines, own = page_lines(text, title)
    return [x.strip() for x, f in zip(lines, furniture(lines, title, own)) if x.strip() and not f]


def _host(url: str | None) -> str | None:
    m = HOST.match(url or "")
    return m[1].lower() if m else None


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def repeated_lines(df: DataFrame, text: str, title: str, url: str) -> DataFrame:
    """``host`` and ``lines`` (hashes of 64 bits) of the lines that are repeated over the pages of a host.

    A page's content is its longest line that isn't furniture by itself, for that line the next one: copies of a page
    and equal error pages so count once. Lines without host or without another line beside them are no evidence.
    Distinct (host, line, content) are combined before the shuffle; every line counts, none is sampled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                hosts, lines, contents = [], [], []
                for t, h, u in zip(*(part.column(c).to_pylist() for c in range(3))):
                    host = _host(u)
                    if host is None or "\n" not in t:
                        continue
                    own = t.split("\n")
                    kept = {x.strip() for x, f in zip(own, furniture(own, h)) if x.strip() and not f}
                    longest = sorted(kept, key=lambda x: (-len(x), x))[:2]
                    if len(longest) < 2:
                        continue
                    first, second = map(_hash, longest)
                    for x in [None, *kept]:
                        hosts.append(host)
                        lines.append(None if x is None else _hash(x))
                        contents.append(second if x == longest[0] else first)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(lines, pa.int64()), pa.array(contents, pa.int64())], names=["host", "line", "content"])

    plain = df.select(F.col(text).cast("string").alias("text"), F.col(title).cast("string").alias("title"), F.col(url).cast("string").alias("url")).where("text is not null")
    counted = plain.mapInArrow(run, "host string, line bigint, content bigint").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED)
    by_host = counted.groupBy("host").agg(F.max(F.when(F.col("line").isNull(), F.col("n"))).alias("all"), F.collect_list(F.struct("line", "n")).alias("seen"))
    often = F.filter("seen", lambda x: x["line"].isNotNull() & (x["n"] >= REPEATED_SHARE * F.col("all")))
    return by_host.select("host", F.transform(often, lambda x: x["line"]).alias("lines")).where("size(lines) > 0")


def furniture_lines(df: DataFrame, key: str, text: str, title: str, url: str | None = None) -> DataFrame:
    """Key and line_no (from 0, lines between LF characters) of every line that is page furniture.

    Null and empty texts and texts without LF have no lines; blank lines never count; a null title is no help but no
    hindrance. Repeated rows repeat their lines, other columns are not read. With ``url``, lines repeated over the
    pages of a host are counted first, and are furniture; without it rows are independent and nothing is shuffled.
    """
    plain = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(title).cast("string").alias("title"), (F.col(url) if url else F.lit(None)).cast("string").alias("url")).where("text is not null")
    known: dict[str, frozenset[int]] = {}
    joined = False
    if url:
        repeated = checkpoint(repeated_lines(df, text, title, url))
        joined = (repeated.agg(F.sum(F.size("lines"))).first()[0] or 0) > BROADCAST_LINES
        if joined:
            host = F.udf(_host, "string")
            plain = plain.withColumn("host", host("url")).join(repeated, "host", "left").select("key", "text", "title", "url", "lines")
        else:
            known = {r[0]: frozenset(r[1]) for r in repeated.collect()}
    shared = df.sparkSession.sparkContext.broadcast(known)

    def places(lines: list[str], hashes: Collection[int]) -> Collection[int]:
        return {i for i, x in enumerate(lines) if x.strip() and _hash(x.strip()) in hashes} if hashes else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = []
                for i, (t, h, u) in enumerate(zip(*(part.column(c).to_pylist() for c in range(1, 4)))):
                    lines = t.split("\n") if "\n" in t else []
                    hashes = frozenset(part.column(4)[i].as_py() or ()) if joined else shared.value.get(_host(u), ())
                    found.append([k for k, f in enumerate(furniture(lines, h, repeated=places(lines, hashes))) if f])
                index = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), pa.array([i for x in found for i in x], pa.int32())], names=["key", "line_no"])

    return plain.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, line_no int").withColumnRenamed("key", key)
