"""Template residue, filler and error-page text in the main body of pages.

Four character n-gram models are fitted: filler, error notices (demands for scripts among them), template fields and
natural prose. Seeds of the first three are texts any web server, typesetter or template language uses; notices also
come from every row whose status tells of a failure, prose from every row. Where the likelihood ratio against prose,
averaged over a window, is high, the text is residue of that kind; units of text (sentences and short lines) that
windows cover are localised as residue, and a page is excluded by how much of its main body they cover. What windows
localise as a template field is held against the notations of fields; one that is quoted, or that a sentence explains,
is part of the prose.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.mainbody import main_content
from webloom.session import checkpoint

#: Lengths of the n-grams whose conditional probabilities are multiplied; size of the hashed tables.
ORDERS = (2, 3, 4, 5)
TABLE = 1 << 18
#: Characters of prose, and of notices learned from failed rows, that the additive smoothing is set for: the counts of
#: more text than that are scaled to it, so that every row counts and smoothing weighs the same however many there are.
PROSE_SIZE, SAID_SIZE = 1_200_000, 50_000
#: Characters that are hashed at once, counts in a row of the shuffle that adds them up, and the steps of a score.
CHUNK, SLOT, STEPS = 1 << 17, 2048, 1 << 16
#: Status from which on a row has failed; the body of a failed row is a notice if its mean log ratio is above this
#: (prose has -2 and less).
FAILED, LEAST_RATIO = 400, -1.6
#: Characters of a window of the field model.
FIELD_WINDOW = 6
#: Characters of a likelihood-ratio window, and the mean log ratio from which it is residue.
WINDOW = 20
RATIO = 0.35
#: Share of a unit that windows of filler must cover, letters that such units must hold in all, and share of the main
#: body that windows of error notices must cover.
UNIT_COVER = 0.5
FILLER_LETTERS = 16
PAGE_COVER = 0.3
#: Units of the prose sample that windows cover this much are left out when prose is fitted again.
REFIT_COVER = 0.2

# Texts the filler model is fitted on, as typesetters, page builders and testers use them.
FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Curabitur pretium tincidunt lacus. Nulla gravida orci a odio. Nullam varius, turpis et commodo pharetra, est eros bibendum elit, nec luctus magna felis sollicitudin mauris. Integer in mauris eu nibh euismod gravida. Duis ac tellus et risus vulputate vehicula. Donec lobortis risus a elit. Etiam tempor. "
    "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae. Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Quisque velit nisi, pretium ut lacinia in, elementum id enim. Vivamus magna justo, lacinia eget consectetur sed, convallis at tellus. Proin eget tortor risus. Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam.",
    "test test test testing 1 2 3 foo bar baz qux quux foo bar foobar spam eggs blah blah blah bla bla bla yada yada xxx xxxx aaa bbb ccc abc abc asdf asdf asdfgh qwerty qwertz qwer zxcv jkl hjkl lorem sample dummy text placeholder hello world test page test post test entry 123 1234",
    "This is a sample text. This is dummy text. This is some placeholder text. Dummy content. Your text goes here. Your content goes here. Enter your text here. Insert your text here. Type something here. Add your description here. Put your headline here. Replace this text with your own. "
    "Text to follow. Copy to come. To be added. To be announced. To be supplied. To be determined. TBD TBA TBC TODO FIXME XXX. Headline goes here. Heading text. Subtitle here. Section title. Untitled document. Image caption. Lorem. Description of the item. Sample description. Example paragraph of body copy. "
    "This is an example page. Welcome to your new site. This is your first post. Edit or delete it, then start writing. Tell visitors about yourself. Click here to edit. Double click to change this text. Just another website. Coming soon.",
    "Texto de ejemplo. Texto de relleno. Escriba su texto aquí. Texte d'exemple. Texte de remplissage. Votre texte ici. Beispieltext. Blindtext. Platzhalter. Hier steht Ihr Text. Hier könnte Ihr Text stehen. Пример текста. Текст-заполнитель. Введите текст. Здесь будет ваш текст. 示例文本。占位文字。在此输入文字。这里是内容。测试测试。",
)
# Texts the error model is fitted on, as web servers, frameworks and guards send them.
NOTICES = (
    "400 Bad Request. 401 Unauthorized. 403 Forbidden. 404 Not Found. 405 Method Not Allowed. 406 Not Acceptable. 408 Request Timeout. 409 Conflict. 410 Gone. 418. 422 Unprocessable Content. 429 Too Many Requests. 451 Unavailable For Legal Reasons. "
    "500 Internal Server Error. 501 Not Implemented. 502 Bad Gateway. 503 Service Unavailable. 504 Gateway Timeout. HTTP Error 404. Error 404. Error 500. Error code 522. Status 503. 404 page not found. Server error. Page not found. File not found. Not found. Gone. Forbidden. Access denied. Permission denied.",
    "The requested URL was not found on this server. The page you requested could not be found. The page you are looking for might have been removed, had its name changed, or is temporarily unavailable. The page you were looking for doesn't exist. You may have mistyped the address or the page may have moved. "
    "Sorry, we couldn't find that page. We can't find the page you are looking for. The link you followed is broken or outdated. We lost that page. Take me home. It looks like nothing was found at this location. Maybe try a search or go back to the home page. Check the address and try again. This page does not exist. This content is no longer available. This article has been deleted. The resource has been removed or expired. This item was deleted by its author.",
    "The server encountered an internal error or misconfiguration and was unable to complete your request. The server encountered an unexpected condition. Sorry, something went wrong. We're working on it. An unexpected error occurred. An error has occurred while processing your request. There was a problem loading this page. Please try again later. Please refresh the page. "
    "There has been a critical error on this website. Whitelabel error page. If the problem persists, contact the administrator and quote reference 123. Error reference: 12ab34. Request id 7f3a. Incident number. Unable to load. Failed to load. Could not load content. This page cannot be displayed. This page isn't working. Error establishing a database connection. Unable to connect to the database. Connection refused. Connection reset. Connection timed out. The upstream server did not respond in time. The origin server is unreachable.",
    "The server is temporarily unable to service your request due to maintenance downtime or capacity problems. We are down for maintenance. The site is temporarily unavailable. Briefly unavailable for scheduled maintenance. Check back in a few minutes. We will be back shortly. Too many requests. You have been rate limited. Slow down and try again after 60 seconds. Bandwidth limit exceeded. "
    "You don't have permission to access this resource. You are not authorized to view this page. You do not have access. Access to this page has been denied. Your IP address has been blocked. Sorry, you have been blocked. Please log in to continue. Your session has expired. This account has been suspended. This domain has expired. This site is offline. Please complete the captcha. Verify that you are a human. Unusual traffic from your network. Ray ID 12f34. nginx/1.18.0 Apache/2.4.41 Server at Port 80.",
    "Fatal error: Uncaught Error: Call to undefined function in /var/www/html/index.php on line 12. Parse error: syntax error, unexpected end of file. Warning: Undefined variable in /home/site/page.php on line 58. Notice: Undefined index. Deprecated. Traceback (most recent call last): File line in module. Exception in thread main java.lang.NullPointerException at. Stack trace: thrown in. Unhandled exception. "
    "SQLSTATE[HY000] [2002] No such file or directory. ORA-00942 table or view does not exist. Segmentation fault. TypeError: undefined is not a function. Error: Cannot read properties of undefined. Template not found. No route matches. Internal error.",
    "You need to enable JavaScript to run this app. Please enable JavaScript to continue. Please turn JavaScript on and reload the page. JavaScript is required to view this page. JavaScript is disabled in your browser. This site requires JavaScript and cookies. This page needs scripts. Enable scripts and refresh. Please enable cookies. Your browser is not supported. Please upgrade your browser. Please disable your ad blocker. Allow scripts for this website in your browser settings. "
    "Checking your browser before accessing the site. This process is automatic. Your browser will redirect shortly. Please wait while we verify your browser. Just a moment. One moment please. Redirecting. Loading. Loading, please wait. If you are not redirected, click here.",
    "Página no encontrada. No se ha encontrado la página. La página que busca no existe o ha sido movida. El contenido ya no está disponible. La dirección no es correcta. Error interno del servidor. Error del servidor. Se ha producido un error. Algo salió mal. Inténtelo de nuevo más tarde. Vuelva a intentarlo dentro de unos minutos. Acceso denegado. No tiene permiso para ver esta página. Servicio no disponible. Sitio en mantenimiento. Demasiadas solicitudes. "
    "Debe habilitar JavaScript para ver esta página. Este sitio necesita JavaScript para funcionar. Active JavaScript en su navegador y recargue la página. Solicitud incorrecta. Tiempo de espera agotado. Cargando, espere por favor.",
    "Page introuvable. La page que vous cherchez n'existe pas ou a été déplacée. La page demandée n'existe plus. Ce contenu n'est plus disponible. Vérifiez l'adresse. Erreur interne du serveur. Erreur du serveur. Une erreur est survenue. Une erreur s'est produite. Veuillez réessayer plus tard. Veuillez réessayer dans quelques minutes. Accès refusé. Accès interdit. Vous n'avez pas l'autorisation. Service indisponible. Le site est temporairement hors service. Site en maintenance. Trop de requêtes. "
    "Vous devez activer JavaScript pour afficher cette page. Ce site a besoin de JavaScript pour fonctionner. Activez JavaScript dans votre navigateur et rechargez la page. Requête incorrecte. Délai d'attente dépassé. Chargement en cours, veuillez patienter.",
    "Seite nicht gefunden. Die gesuchte Seite existiert nicht oder wurde verschoben. Die angeforderte Seite wurde nicht gefunden. Dieser Inhalt ist nicht mehr verfügbar. Bitte prüfen Sie die Adresse. Interner Serverfehler. Serverfehler. Es ist ein Fehler aufgetreten. Etwas ist schiefgelaufen. Bitte versuchen Sie es später erneut. Bitte versuchen Sie es in einigen Minuten noch einmal. Zugriff verweigert. Sie haben keine Berechtigung. Dienst nicht verfügbar. Wartungsarbeiten. Zu viele Anfragen. Fehler 404. "
    "Diese Seite benötigt JavaScript. Bitte aktivieren Sie JavaScript in Ihrem Browser und laden Sie die Seite neu. Um die Anwendung zu nutzen, muss JavaScript eingeschaltet sein. Ungültige Anfrage. Zeitüberschreitung. Wird geladen, bitte warten.",
    "Страница не найдена. Запрошенная страница не существует или была перемещена. Такой страницы нет. Материал больше недоступен. Проверьте адрес. Внутренняя ошибка сервера. Ошибка сервера. Произошла ошибка. Что-то пошло не так. Попробуйте позже. Повторите попытку через несколько минут. Доступ запрещён. Доступ закрыт. У вас нет прав для просмотра. Сервис временно недоступен. Ведутся технические работы. Слишком много запросов. Ошибка 404. "
    "Для работы сайта необходим JavaScript. Включите JavaScript в браузере и обновите страницу. Неверный запрос. Время ожидания истекло. Загрузка, подождите.",
    "页面未找到。页面不存在。找不到页面。您访问的页面不存在或已被删除。您要查找的页面已被移动、删除或改名。该页面已被删除或移动到新地址。页面已被删除。您访问的内容已被删除。此网页暂时无法访问。网站暂时无法打开，请稍后再试。服务器暂时无法响应请求，请稍后重试。您请求的内容已过期。该链接已失效。抱歉，页面出现错误。该内容已不可用。请检查网址。服务器内部错误。服务器错误。发生错误。出错了。请稍后再试。请稍后重试。访问被拒绝。您没有权限查看此页面。服务不可用。网站维护中。请求过多。错误404。此页面需要启用JavaScript。请在浏览器中启用JavaScript后刷新页面。错误的请求。请求超时。正在加载，请稍候。",
)
# Names and notations the field model is fitted on.
FIELD_NAMES = "title name user.name first_name last_name date price author item.price total page_title year count city email url site.name description content id code number product category message value 0 1 2".split()
NOTATIONS = ("{{{{ {} }}}}", "{{{{{}}}}}", "{{{{#{}}}}}", "{{% {} %}}", "{{{}}}", "${{{}}}", "#{{{}}}", "<%= {} %>", "&lt;%= {} %&gt;", "<?php echo ${}; ?>", "&lt;?= ${} ?&gt;", "[[{}]]", "[[ {} ]]", "%({})s", "<<{}>>", "@@{}@@")
LOUD = ("%{}%", "__{}__", "##{}##", "[INSERT {}]")
SAID = ("[Your {} here]", "[your {} here]", "[object Object]")

# Plain prose the prose model always sees, so that a small table has one too.
PROSE = (
    "In the morning the train was late again, and most of the passengers stood on the platform with their newspapers. A woman asked the guard whether the next one would stop at the harbour, but he only shook his head and pointed at the board above the door. "
    "Later that day the council said that it would look into the matter. Nobody had expected an answer before the summer, because the old bridge had been closed twice since the war and every plan to replace it had failed. Some of the older members still remember how the river used to freeze. "
    "The editor told us that the page had shown a notice about scripts for years, and that readers had long stopped seeing it. When the server answered with an error, they simply waited and tried once more. Printers once filled their samples with Latin words before the real text arrived.",
    "Por la mañana el tren llegó tarde otra vez y la mayoría de los viajeros esperaba en el andén con sus periódicos. El alcalde dijo que nadie había visto el informe, aunque todos hablaban de él desde hacía semanas. La casa vieja sigue cerca del río, donde los niños juegan en verano.",
    "Le matin, le train était encore en retard et la plupart des voyageurs attendaient sur le quai avec leurs journaux. Le maire a dit que personne n'avait vu le rapport, alors que tout le monde en parlait depuis des semaines. La vieille maison se trouve toujours près de la rivière.",
    "Am Morgen kam der Zug wieder zu spät, und die meisten Reisenden standen mit ihren Zeitungen auf dem Bahnsteig. Der Bürgermeister sagte, niemand habe den Bericht gesehen, obwohl seit Wochen alle davon sprachen. Das alte Haus steht noch immer am Fluss, wo im Sommer die Kinder spielen.",
    "Утром поезд снова опоздал, и большинство пассажиров стояли на платформе с газетами. Мэр сказал, что никто не видел отчёта, хотя о нём говорили уже несколько недель. Старый дом по-прежнему стоит у реки, где летом играют дети.",
    "早上火车又晚点了，大多数旅客拿着报纸站在站台上。市长说没有人见过那份报告，虽然大家已经谈论了好几个星期。老房子仍然在河边，夏天孩子们在那里玩耍。",
)

# The notations of template fields.
FIELD = regex.compile(
    r"\{\{[#/]?[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|[$#]\{[\w. -]{1,40}\}|(?:<|&lt;)%=?[^%\n]{1,60}%(?:>|&gt;)|(?:<|&lt;)\?(?:php|=)[^?\n]{0,80}\?(?:>|&gt;)|\[\[ ?[a-z_][\w. ]{0,30}\]\]|(?<![\w%])%[A-Z][A-Z_]{2,}%|%\([a-z_]\w*\)[sd]|"
    r"(?<![\w$#{])\{(?:[a-z_][\w.]{0,30}|\d)\}|\[(?:Your|your) [\w -]{2,30} here\]|\[INSERT [^\]\n]{1,40}\]|\[object Object\]|<<[a-z_]\w*>>|(?<!\w)__[A-Z][A-Z_]+__(?!\w)|##[A-Z_]+##|@@[a-z_]\w*@@"
)
QUOTES = {"`": "`", "“": "”", "„": "“”", "«": "»", "‘": "’", '"': '"', "'": "'", "「": "」", "『": "』", "»": "«"}
#: A field that a sentence explains stands within one of these wordings.
EXPLAINED = regex.compile(
    r"\b(?:explains?|means?) (?:only )?(?:that|how|what)\b|\b(?:is|are) (?:filled in|replaced (?:by|with)|substituted)\b|\b(?:stands for|placeholder|the variable|template language|the guide says|the syntax)\b|"
    r"\bse (?:rellena|sustituye)\b|\bsignifica que\b|\bexplica que\b|\best remplacée? par\b|\b(?:signifie|explique) que\b|\bwird (?:durch|ersetzt|ausgefüllt)\b|\b(?:bedeutet|erklärt), dass\b|заменяется на|означает, что|объясняет, что|会被替换|表示|占位符",
    regex.I,
)
SITE_CUT = re.compile(" [|–—-] ")
SENTENCE_CUT = re.compile(r"[.!?…。！？](?:(?<=[。！？])|[”»’\")]*\s+)")
SENTENCE_STARTS = "([{“‘«„¿¡\"<$#%@_&"
#: What any field's notation holds; most texts hold none of it.
FIELD_MARKS = ("{", "&lt;", "<%", "<?", "<<", "[[", "%(", "__", "##", "@@", "[Your", "[your", "[INSERT", "[object", "%")
#: What any field has in it, as one look.
MARKED = re.compile(r"[{<&\[%_#@]")
DIGITS, DIGIT = regex.compile(r"\d+"), re.compile(r"\d")
SMALL, CAPITAL = regex.compile(r"[\p{Ll}\p{Lo}\p{M}]"), regex.compile(r"\p{Lu}")
TERMINATORS = ".!?…。！？;；"


def _shuffled() -> list[str]:
    """The filler words in many orders, as generators of dummy text put them."""
    random = np.random.default_rng(11)
    out = []
    for text in FILLER[:3]:
        words = [w.strip(".,").lower() for w in text.split()]
        for _ in range(12):
            out.append(" ".join(random.permutation(words)))
    return out


def _fields() -> str:
    """Unfilled fields of every notation, amid the blanks and marks that stand around them."""
    loud = [n.upper().replace(".", "_") for n in FIELD_NAMES if not n.isdigit()]
    said = [n.replace("_", " ").replace(".", " ") for n in FIELD_NAMES if not n.isdigit()]
    written = [x.format(n) for names, notations in ((FIELD_NAMES, NOTATIONS), (loud, LOUD), (said, SAID)) for x in notations for n in names]
    return " ".join(f"{w}{mark}" for i, w in enumerate(written) for mark in (" ", ",\n", ".", "!")[i % 4])


def shape(text: str) -> str:
    """A text with its letters alike, small and capital ones apart: what remains is its notation."""
    return CAPITAL.sub("A", SMALL.sub("a", text))


@cache
def _shapes() -> np.ndarray:
    """For every character, the one that ``shape`` puts in its place."""
    every = "".join(map(chr, range(0x110000)))
    return np.frombuffer(shape(every).encode("utf-32-le", "surrogatepass"), np.uint32)


def _small(text: str) -> str:
    """A text in small letters; a few capitals have longer small forms, and stay since places must."""
    lower = text.lower()
    if len(lower) == len(text):
        return lower
    return "\n".join(x.lower() if len(x.lower()) == len(x) else "".join(c if len(c.lower()) != 1 else c.lower() for c in x) for x in text.split("\n"))


def grams(text: str, shaped: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, hashes of the n-gram that ends at each character, and of its context; digits alike.

    Letters are small ones, or those of the text's shape. An n-gram that begins before the newline ahead of its line has
    hash 0, which is never counted, so that units count the same in any order.
    """
    codes = np.frombuffer((text if shaped else _small(text)).encode("utf-32-le", "replace"), np.uint32)
    if shaped:
        codes = _shapes().take(codes)
    n, out = len(codes), []
    starts = np.concatenate(([0], np.flatnonzero(codes == 10) + 1))
    codes = np.concatenate((np.full(ORDERS[-1], 10, np.uint64), np.where((codes >= 48) & (codes <= 57), 48, codes).astype(np.uint64))) + np.uint64(1)
    h = codes[ORDERS[-1] :].copy()
    context = np.zeros(n, np.uint64)
    shifted = codes << np.uint64(21)
    for k in range(1, ORDERS[-1]):
        before = slice(ORDERS[-1] - k, ORDERS[-1] - k + n)
        h ^= shifted[before]
        h *= np.uint64(0x9E3779B97F4A7C15)
        context ^= codes[before]
        context *= np.uint64(0xC2B2AE3D27D4EB4F)
        pair = h >> np.uint64(20), context >> np.uint64(20)
        for x in pair:
            x &= np.uint64(TABLE - 1)
        pair = tuple(x.view(np.intp) for x in pair)
        for j in range(k - 1):
            across = starts[starts + j < n] + j
            pair[0][across] = pair[1][across] = 0
        out.append(pair)
    return out


class Model:
    """Counts of n-grams and contexts, with additive smoothing, for every order."""

    def __init__(self, texts: Iterable[str] = (), shaped: bool = False, counts: np.ndarray | None = None):
        self.counts = np.zeros((2, len(ORDERS), TABLE)) if counts is None else counts
        for t in texts:
            self.add(grams(t, shaped))

    def add(self, hashed: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray | None = None) -> None:
        """Add the n-grams at some places, or at all of them."""
        for k, pair in enumerate(hashed):
            for side, h in enumerate(pair):
                own = h if at is None else h[at]
                if 8 * len(own) < TABLE:
                    np.add.at(self.counts[side, k], own, 1.0)
                else:
                    self.counts[side, k] += np.bincount(own, minlength=TABLE)
        self.counts[:, :, 0] = 0

    def scaled(self, size: int) -> Model:
        """The counts, scaled to those of ``size`` characters if there are more."""
        return Model(counts=self.counts * min(1.0, size / max(1.0, self.counts[0, 0].sum())))

    def __add__(self, other: Model) -> Model:
        return Model(counts=self.counts + other.counts)

    def __sub__(self, other: Model) -> Model:
        return Model(counts=self.counts - other.counts)

    def logs(self, unseen: float, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        return np.log(self.counts[0] * weight + unseen), np.log(self.counts[1] * weight + 30.0)


class Residue:
    """Log-likelihood ratios of filler, error notices and template fields against prose, as tables to look up."""

    def __init__(self, prose: list[str], failed: list[str] = []):  # noqa: B006
        parts = [*_units_of(prose)]
        bodies = [*dict.fromkeys(DIGITS.sub("0", b) for b in failed if b)]

        def said(model: Residue) -> Model:
            notices = Model()
            Residue.count(None, [*_units_of(model.like_notices(bodies))], notices)
            return notices

        def natural(model: Residue | None, counts: Model, notation: Model | None) -> None:
            Residue.count(model, parts, counts, notation)

        self._fit(natural, said if bodies else None)

    @classmethod
    def fitted(cls, natural: Callable, said: Callable | None) -> Residue:
        """A model of counts made elsewhere: ``natural`` adds those of ``count`` over the rows, ``said`` returns those of failed rows."""
        self = cls.__new__(cls)
        self._fit(natural, said)
        return self

    def _fit(self, natural: Callable, said: Callable | None) -> None:
        # seeds as they stand, and a sentence a line
        seeds = [Model([*FILLER, *_shuffled(), "\n".join(units([*FILLER]))]), Model([*NOTICES, "\n".join(units([*NOTICES]))])]
        classes = [*seeds]
        # the rows hold residue too: units that come again (residue does) count once, digits alike, and prose is fitted
        # again, twice, without the units that look like residue: those few are counted and taken off
        plain = [*_units_of(PROSE)]
        every = Model()
        for again in range(3):
            judge = self if again else None
            counts, notation = Model() if again else every, None if again else Model()
            Residue.count(judge, plain, counts, notation)
            natural(judge, counts, notation)
            counts = (every - counts if again else every).scaled(PROSE_SIZE)
            if notation is not None:
                self.field_tables = self._ratios([Model([_fields()], shaped=True)], notation.scaled(PROSE_SIZE))
            self.tables = self._ratios(classes, counts)
            if said is not None:  # what failed rows say and prose hardly would are notices of this corpus' own wording
                classes[1] = seeds[1] + said(self).scaled(SAID_SIZE)
                self.tables = self._ratios(classes, counts)

    def without_fields(self) -> Residue:
        """The model of filler and notices alone, which is smaller."""
        out = Residue.__new__(Residue)
        out.tables = self.tables
        return out

    def count(self: Residue | None, parts: list[str], natural: Model, notation: Model | None = None) -> None:
        """Add the n-grams of units, and of their shapes, without fields; with a model, only of units that it covers."""
        for text, sizes in _chunks(parts):
            hashed = grams(text)
            keep = np.ones(len(text), bool)
            if self is not None:
                residue = self.alone(hashed, sizes) >= REFIT_COVER
                if not residue.any():
                    continue
                keep = np.repeat(residue, sizes + 1)
            if MARKED.search(text):
                for m in FIELD.finditer(text):  # the fields of the rows are no prose
                    keep[m.start() : min(m.end() + ORDERS[-1], text.index("\n", m.end() - 1) + 1)] = False
            at = None if keep.all() else np.flatnonzero(keep)
            if notation is not None:
                notation.add(grams(text, shaped=True), at)
            natural.add(hashed, at)

    def alone(self, hashed: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray) -> np.ndarray:
        """For units of these sizes, a line each, the greater share that windows within the unit cover, of filler or notices.

        Scores are summed as whole numbers, so that a unit's share is the same beside any others.
        """
        steps = self.scores(hashed, self.tables)
        steps *= STEPS
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        short = np.flatnonzero(sizes < WINDOW)  # their one window is the unit
        out = np.zeros(len(sizes))
        sums = np.zeros(len(steps) + 1, np.int64)
        for own in np.rint(steps, out=steps).T:
            np.cumsum(own, dtype=np.int64, out=sums[1:])
            at = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] > RATIO * STEPS * WINDOW)  # few, if any
            unit = np.searchsorted(ends, at)
            inside = at + WINDOW <= ends[unit]
            at, unit = at[inside], unit[inside]
            if len(at):
                new = np.full(len(at), WINDOW)  # characters that a window covers and the next one doesn't
                new[:-1] = np.where(unit[1:] == unit[:-1], np.minimum(at[1:] - at[:-1], WINDOW), WINDOW)
                covered = np.bincount(unit, new, len(sizes))
                out = np.maximum(out, covered / sizes)
            hot = sums[ends[short]] - sums[starts[short]] > RATIO * STEPS * sizes[short]
            out[short[hot]] = 1.0
        return out

    @staticmethod
    def _ratios(classes: list[Model], natural: Model) -> tuple[np.ndarray, np.ndarray]:
        """(joint, context) tables by order and hash, the classes side by side so that one look finds both."""
        nj, nc = natural.logs(0.1)
        logs = [m.logs(0.02, 6.0) for m in classes]  # what residue and prose have once each speaks for residue
        return tuple(np.stack([(x[k] - n) / len(ORDERS) for x in logs], -1).astype(np.float32) for k, n in enumerate((nj, nc)))

    @staticmethod
    def scores(hashed: list[tuple[np.ndarray, np.ndarray]], tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """For each character, its log ratios of the classes."""
        joint, context = tables
        score = np.zeros((len(hashed[0][0]), joint.shape[-1]), np.float32)
        for k, (g, c) in enumerate(hashed):
            score += joint[k].take(g, 0)
            score -= context[k].take(c, 0)
        return score

    def like_notices(self, bodies: list[str]) -> list[str]:
        """The bodies whose mean log ratio of notices is above that of prose."""
        out = []
        for body in bodies:
            steps = np.rint(self.scores(grams(body), self.tables)[:, 1] * STEPS).astype(np.int64)
            if steps.sum() > LEAST_RATIO * STEPS * len(body):
                out.append(body)
        return out

    def fields(self, text: str) -> np.ndarray:
        """For each character, whether a window of the field model covers it."""
        n, width = len(text), min(FIELD_WINDOW, len(text))
        sums = np.concatenate(([0.0], np.cumsum(self.scores(grams(text, shaped=True), self.field_tables)[:, 0], dtype=np.float64)))
        edge = np.zeros(n + 1, np.int64)
        hot = (sums[width:] - sums[:-width]) > RATIO * width
        edge[: n - width + 1] += hot
        edge[width : n + 1] -= hot
        return np.cumsum(edge)[:-1] > 0

    def covers(self, parts: list[str]) -> list[list[float]]:
        """For filler and notices, the share of each unit's characters that windows cover."""
        text = "\n".join(parts)
        if not text:
            return [[0.0] * len(parts)] * 2
        n = len(text)
        width = min(WINDOW, n)
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = ends - [len(p) + 1 for p in parts]
        out = []
        score = self.scores(grams(text), self.tables)
        sums = np.zeros((n + 1, 2))
        np.cumsum(score, 0, dtype=np.float64, out=sums[1:])
        hots = (sums[width:] - sums[:-width]) > RATIO * width
        for hot in hots.T:
            if not hot.any():
                out.append([0.0] * len(parts))
                continue
            edge = np.zeros(n + 1, np.int64)
            edge[: n - width + 1] += hot
            edge[width : n + 1] -= hot
            covered = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
            out.append([float(covered[b - 1] - covered[a]) / max(1, b - 1 - a) for a, b in zip(starts, ends)])
        return out

    def kinds(self, lines: list[str], title: str | None) -> tuple[bool, bool, bool]:
        """(unfilled field, filler, error notice) for the main body of a page."""
        if not lines:
            return False, False, False
        field = unfilled("\n".join(lines), self)
        rest = without_headline(lines, title)
        parts = [*units(rest)]
        sizes = [len(u) - u.count(" ") for u in parts]
        fillers, notices = self.covers(parts)
        total = max(1, sum(sizes))
        filler = sum(s for s, f, e in zip(sizes, fillers, notices) if f >= UNIT_COVER and f >= e and s >= 8)
        notice = sum(s * e for s, e in zip(sizes, notices))
        mixed = sum(s * max(f, e) for s, f, e in zip(sizes, fillers, notices))
        short = sum(s for s, f in zip(sizes, fillers) if f >= UNIT_COVER)
        return field, bool(filler >= FILLER_LETTERS or short > 0.5 * total), bool(notice >= PAGE_COVER * total or mixed >= 0.8 * total and notice >= 0.2 * total)


def without_headline(lines: list[str], title: str | None) -> list[str]:
    """The lines without a headline that repeats the page's title (which may carry the site's name) if more follows."""
    title = (title or "").strip()
    out = [*lines]
    if title and len(" ".join(out)) > len(title) + 8:
        for candidate in sorted({title, *SITE_CUT.split(title)}, key=len, reverse=True):
            while out and len(candidate) > 4 and out[0].startswith(candidate) and out[0][len(candidate) : len(candidate) + 1].strip() == "":
                out[0] = out[0][len(candidate) :].strip()
                if not out[0]:
                    out = out[1:]
    return out


def _units_of(bodies: Iterable[str]) -> set[str]:
    """The units of some bodies, each once, digits alike."""
    return {u for p in bodies for u in units(DIGIT.sub("0", p).split("\n"))}


def _chunks(parts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """Units a line each, as texts of bounded size, with the sizes of the units."""
    own: list[str] = []
    size = 0
    for p in parts:
        own.append(p)
        size += len(p) + 1
        if size >= CHUNK:
            yield "\n".join(own) + "\n", np.array([len(x) for x in own])
            own, size = [], 0
    if own:
        yield "\n".join(own) + "\n", np.array([len(x) for x in own])


def unfilled(text: str, model: Residue | None = None) -> bool:
    """Whether a text holds a template field that is neither quoted nor explained by its sentence.

    Windows of the field model localise fields, and the notations of fields are the check that follows. A text without
    any of their marks has no such window. Without a model the notations alone are looked for.
    """
    if not any(x in text for x in FIELD_MARKS):
        return False
    found = [*FIELD.finditer(text)]
    if not found:
        return False
    covered = np.ones(len(text), bool) if model is None else model.fields(text)
    for m in found:
        a, b = m.span()
        if not covered[a:b].any():
            continue
        before, after = text[a - 1 : a], text[b : b + 1]
        if before in QUOTES and before and after and after in QUOTES[before]:
            continue
        start = max(text.rfind(x, 0, a) for x in (". ", "! ", "? ", "。", "\n\n")) + 1
        end = min([i for i in (text.find(x, b) for x in (". ", ".\n", "。", "\n\n")) if i >= 0] or [len(text)])
        sentence = text[start:end]
        said = FIELD.sub(" ", sentence)
        if EXPLAINED.search(said) and len(said) - said.count(" ") > 25 and len(FIELD.findall(sentence)) == 1:
            continue
        return True
    return False


def unwrapped(lines: list[str]) -> list[str]:
    """Lines with hard wraps undone.

    A page was wrapped if, of its lines that end no sentence, most are so long that the next line's first word would
    have passed the longest one. A line that goes on in small letters is always joined to the one before.
    """
    open_ends = [(len(x), len(y.split(None, 1)[0])) for x, y in zip(lines, lines[1:]) if x and y.strip() and x[-1] not in TERMINATORS]
    width = max((n for n, _ in open_ends), default=0)
    full = sum(n + 1 + w > width for n, w in open_ends)
    rows = sum("|" in x or "\t" in x or ";" in x or "  " in x or " , " in x for x in lines)
    if rows >= 0.3 * len(lines):
        return lines  # rows of cells
    wrapped = 24 <= width <= 110 and len(open_ends) >= 3 and full >= 0.6 * len(open_ends)
    out: list[str] = []
    last = 0
    for line in lines:
        fits = wrapped and out and last + 1 + len((line.split(None, 1) or [""])[0]) <= width
        if out and out[-1][-1:] not in TERMINATORS + ":" and (line[:1].islower() or wrapped and not fits):
            out[-1] += " " + line
        else:
            out.append(line)
        last = len(line)
    return out


def units(lines: list[str]) -> Iterator[str]:
    """Sentences and short lines, wraps undone."""
    return sentences(unwrapped(lines))


def sentences(lines: list[str]) -> Iterator[str]:
    """Sentences and short lines of lines without wraps."""
    for line in lines:
        start = 0
        for m in SENTENCE_CUT.finditer(line):
            end = m.end()
            after = line[end : end + 1]
            if m[0] in "。！？" or after and (after.isupper() or after.isdigit() or after in SENTENCE_STARTS):
                if part := line[start:end].strip():
                    yield part
                start = end
        if part := line[start:].strip():
            yield part


def _sample(df: DataFrame, key: str, text: str, title: str, rows: int) -> DataFrame:
    """At most ``rows`` rows with text: those of the smallest key hashes, the same however the table is split."""
    return df.where(F.length(text) > 0).orderBy(F.xxhash64(key), F.xxhash64(text, title), text, title).limit(rows)


def bodies(df: DataFrame, key: str, text: str, title: str, status: str | None = None, more: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """Key (as ``key``), title, failed, ``more`` columns and lines of the main body of every row whose text isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(0).to_pylist()
                index = [i for i, t in enumerate(texts) if t and not t.isspace()]
                part = part.take(pa.array(index, pa.int64()))
                lines = [main_content(texts[i], h) for i, h in zip(index, part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(lines, pa.list_(pa.string()))], names=[*part.schema.names[1:], "lines"])

    failed = F.lit(False) if status is None else F.coalesce(F.col(status) >= FAILED, F.lit(False))
    plain = df.select(F.col(text).cast("string").alias("text"), F.col(key).alias("key"), F.col(title).cast("string").alias("title"), failed.alias("failed"), *(c.alias(n) for n, c in more.items())).where("text is not null")
    fields = ", ".join(f"`{n}` {kind}" for n, kind in plain.dtypes[1:])
    return plain.mapInArrow(run, f"{fields}, lines array<string>")


def _distinct_units(lines: DataFrame, model: Broadcast | None = None) -> DataFrame:
    """The units of all main bodies, each once, digits alike; with a model, those of bodies that read as its notices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["\n".join(x) for x in batch.column(0).to_pylist() if x]
            if model is not None:
                found = model.value.like_notices(found)
            yield pa.RecordBatch.from_arrays([pa.array([*_units_of(found)], pa.string())], names=["unit"])

    return lines.select("lines").mapInArrow(run, "unit string").distinct()


def _add_counts(units: DataFrame, models: list[Model], judge: Broadcast | None = None) -> None:
    """Add the n-grams of all units to the models (of prose, and of notation if there is a second).

    Tables have a fixed size, whatever the rows, and as many are made as tasks run side by side; they are added up by a
    shuffle, and the driver gets one of each.
    """
    many = len(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Model() for _ in range(many)]
        for batch in batches:
            Residue.count(None if judge is None else judge.value, batch.column(0).to_pylist(), *own)
        counts = np.concatenate([m.counts.ravel() for m in own]).reshape(-1, SLOT)
        filled = np.flatnonzero(counts.any(1))
        for at in range(0, len(filled), 256):
            some = filled[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([counts[i].tobytes() for i in some], pa.binary())], names=["slot", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(c.as_buffer(), np.float64)
                sums[i] = sums[i] + counts if i in sums else counts.copy()
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["slot", "counts"])

    schema = "slot int, counts binary"
    tasks = units.sparkSession.sparkContext.defaultParallelism
    slots = [x.reshape(-1, SLOT) for x in (m.counts.reshape(-1) for m in models)]
    for slot, counts in units.coalesce(tasks).mapInArrow(run, schema).repartition(tasks, "slot").mapInArrow(total, schema).collect():
        slots[slot // len(slots[0])][slot % len(slots[0])] += np.frombuffer(counts, np.float64)


def fitted(main: DataFrame, failed: DataFrame | None) -> Residue:
    """The models of stored main bodies: prose of all of ``main``, notices also of ``failed``, which all count.

    Units and bodies that come again count once over the whole table.
    """
    context = main.sparkSession.sparkContext
    units = checkpoint(_distinct_units(main))
    if failed is not None:
        same = F.transform("lines", lambda x: F.regexp_replace(x, r"\d+", "0"))
        failed = checkpoint(failed.select(same.alias("lines")).where("size(lines) > 0").distinct())

    @contextmanager
    def shared(model: Residue) -> Iterator[Broadcast]:
        sent = context.broadcast(model.without_fields())
        try:
            yield sent
        finally:
            sent.destroy()  # else its copies stay on the disk of every executor

    def natural(judge: Residue | None, counts: Model, notation: Model | None) -> None:
        if judge is None:
            return _add_counts(units, [counts, notation])
        with shared(judge) as sent:
            _add_counts(units, [counts], sent)

    def said(model: Residue) -> Model:
        notices = Model()
        with shared(model) as sent:
            _add_counts(_distinct_units(failed, sent), [notices])
        return notices

    return Residue.fitted(natural, None if failed is None else said)


def fit(df: DataFrame, key: str, text: str, title: str, status: str | None = None, rows: int | None = None, failed_rows: int | None = None) -> Residue:
    """The models: prose fitted on all rows, notices also on all rows of a failed status.

    Callers that want models of a few rows may bound both; no query does.
    """
    own = lambda d, most: checkpoint(bodies(d if most is None else _sample(d, key, text, title, most), key, text, title))
    failed = None
    if rows is None and failed_rows is None:
        main = checkpoint(bodies(df, key, text, title, status))
        failed = None if status is None else main.where("failed")
    else:
        main = own(df, rows)
        failed = None if status is None else own(df.where(F.col(status) >= FAILED), failed_rows)
    return fitted(main, failed)


def residue(df: DataFrame, key: str, text: str, title: str, model: Residue | None = None, status: str | None = None) -> DataFrame:
    """Key, template, filler, notice (BOOLEAN) of every row with residue in its main body.

    Null and empty texts have none; a null title is treated as empty; rows are judged one by one, repeated rows alike.
    Other columns are not read. Main bodies are stored, the models are fitted on all of them, and a map over batches
    judges them; ``status`` names the column whose failures are notices to learn from, and decides about no row.
    """
    main = bodies(df, key, text, title, status)
    if model is None:
        main = checkpoint(main)
        model = fitted(main, None if status is None else main.where("failed"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                kinds = [shared.value.kinds(x, h) for x, h in zip(part.column(2).to_pylist(), part.column(1).to_pylist())]
                index = [i for i, k in enumerate(kinds) if any(k)]
                columns = [pa.array([kinds[i][c] for i in index], pa.bool_()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index, pa.int64())), *columns], names=["key", "template", "filler", "notice"])

    return main.select("key", "title", "lines").mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, template boolean, filler boolean, notice boolean").withColumnRenamed("key", key)
