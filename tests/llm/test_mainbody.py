from webloom.llm import mainbody as M

PAGE = """Skip to content
Home | News | Archive
Basket (3) £12.00
Home » News » How the mill moved the clerk
How the mill moved the clerk
12.3.2021 | Ann Bell
We value your privacy. We and our 12 partners store information on your device. Agree Options
When the clerk counted the mills, the reader praised a temporary and single map. Some sheets behind the harbour closed the calendar; others ignored the caption.
Advertisement

The privacy policy and the terms of use were compared in 1998. Readers in the town nightly trimmed the shallow queues because the editor fetched a calendar.
Read also: The quiet cellar
A short subheading
By 1996 the jagged bulletins praised the harbour, and a market often delivered the link. It was the map, not the garden, that limited the frontiers.
You may also like
How the baker logged the engraving (185)
25.6. Notes on the publisher
Terms of use | Privacy policy | Imprint | Accessibility
© 1991 Chytreas. All rights reserved."""


def flags(text, title=None):
    return [i for i, f in enumerate(M.furniture(text.split("\n"), title)) if f]


def test_page():
    assert flags(PAGE, "How the mill moved the clerk") == [0, 1, 2, 3, 6, 8, 11, 14, 15, 16, 17, 18]
    assert flags(PAGE) == flags(PAGE, "How the mill moved the clerk")


def test_same_content_from_one_line():
    page = PAGE.replace("Read also: The quiet cellar\n", "")  # where a teaser ends can't be told in one line
    lines = M.main_content(page)
    single = " ".join(M.main_content(" ".join(page.split()), "How the mill moved the clerk"))
    assert " ".join(lines).split() == single.split()


def test_messages_are_content():
    assert flags("Menu Close\n404 - Page not found\nCheck the address or go back to the start page.\n© 1991 Chytreas. All rights reserved.") == [0, 3]
    assert flags("Bitte aktivieren Sie JavaScript, um alle Funktionen zu nutzen.\n" + "Der Leser zählte heute 12 Blätter und die alte Karte. " * 4) == [0]
    assert flags("请启用JavaScript以获得完整功能。") == []


def test_languages():
    for lines in (["Ouvrir le menu", "Accueil · Livres · Aide"], ["Меню", "Темы · Книги · Главная"], ["打开菜单", "首页 · 图书 · 专题"], ["Saltar al contenido", "Inicio > Libros > El mapa"]):
        body = "Эта строка длинная и говорит о журнале, который читатель снова открыл в городе. " * 3 if "Меню" in lines else "这是一个很长的段落，编辑在云山城统计了快照，读者打开了目录。" * 4 if "打开菜单" in lines else "La page du livre est longue et le lecteur compte encore les feuilles de la ville. " * 3
        assert flags("\n".join([*lines, body])) == [0, 1]


def test_every_phrase_is_found_by_its_needle():
    for pattern, p in zip(M.PATTERNS, M.PHRASES + M.SCRIPT_NOTICES):
        assert M._needles(p), p
    for text in ("Call us: 000-1-2", "Warenkorb (9) 5,00 €", "Teilen Drucken Merken", "第 3 页", "Tags: a, b", "Fliquaer S. L., calle Fodyth 959, Fiskelford"):
        assert [*M.phrases(text)] == [(0, len(text))], text
    assert [*M.phrases("The cookie settings were discussed, and a basket was sold.")] == []


def test_edges(spark):
    rows = [(1, PAGE, None, "x"), (2, None, "t", "x"), (3, "", "", None), (4, "one line only", None, None), (5, "\n \n", None, None), (6, "Menu Close\r\n" + "word " * 300_000, None, None), (None, "Menu Close\nText that says a little more than a menu does.", None, None), (1, PAGE, None, "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, title string, line_no string")
    got = [tuple(r) for r in M.furniture_lines(df, "id", "text", "title").collect()]
    assert sorted(x for i, x in got if i == 1) == sorted(2 * flags(PAGE)) and (6, 0) in got and (None, 0) in got and not {2, 3, 4, 5} & {i for i, _ in got}
    assert M.furniture_lines(df.limit(0), "id", "text", "title").count() == 0


def test_repeated_lines_of_a_host(spark, monkeypatch):
    digest = "A daily digest of what readers liked best"  # told by its being repeated alone
    body = "The clerk of mill number {0} counted the sacks of the town.\nA reader praised map {0} of the harbour."
    gone = "410 Gone\nThis page was taken down by the people who made it."
    rows = [(i, f"https://a.test/{i}", None, body.format(i) + "\n" + digest) for i in range(30)]
    rows += [(100 + i, f"https://a.test/gone/{i}", None, gone) for i in range(30)]  # the same message is no furniture
    rows += [(200 + i, f"https://b.test/{i}", None, body.format(7) + "\n" + digest) for i in range(30)]  # copies of one page
    rows += [(300, None, None, body.format(1) + "\n" + digest), (301, "https://a.test/x", None, digest + "\n"), (302, "https://a.test/y", None, None)]
    df = spark.createDataFrame(rows, "id bigint, url string, title string, text string")
    want = [(i, 2) for i in range(30)]
    assert sorted(map(tuple, M.furniture_lines(df, "id", "text", "title", "url").collect())) == want
    monkeypatch.setattr("webloom.llm.mainbody.BROADCAST_LINES", -1)
    assert sorted(map(tuple, M.furniture_lines(df, "id", "text", "title", "url").collect())) == want
    assert M.furniture_lines(df.limit(0), "id", "text", "title", "url").count() == 0


UNSEEN = {
    "en": ["Jump straight to the article", "Home | Recipes | Travel", "Join 40,000 readers - subscribe to our newsletter today", "We and our partners use cookies to personalise ads. OK / No thanks", "Follow us on every network"],
    "es": ["Ir al contenido", "Cocina | Viajes | Jardín", "Suscríbete para recibir novedades", "Esta web emplea cookies de terceros. Rechazar / Configurar"],
    "de": ["Direkt zum Inhalt", "Rezepte | Reisen | Garten", "Jetzt anmelden und nichts verpassen", "Diese Website setzt Cookies ein. Akzeptieren / Ablehnen"],
}
TEXTS = {
    "en": ["Why the harbour froze", "In January the harbour froze for nine days, and the ferries stayed where they were until the wind turned.", "Nobody could say whether the fishermen would accept the loss, since cookies and bread had sold out as well.", "Port | Days | Boats", "Ahl | 9 | 14", "Brin | 3 | 2", "Subscribers wrote that they had seen it coming."],
    "es": ["Por qué se heló el puerto", "En enero el puerto se heló durante nueve días y los barcos se quedaron donde estaban hasta que cambió el viento.", "Nadie sabía decir si los pescadores aceptarían la pérdida."],
    "de": ["Warum der Hafen zufror", "Im Januar fror der Hafen für neun Tage zu, und die Fähren blieben liegen, bis der Wind drehte.", "Niemand konnte sagen, ob die Fischer den Verlust hinnehmen würden."],
}


def test_unseen_wordings():
    for lang, top in UNSEEN.items():
        lines = [*top[:2], *TEXTS[lang], *top[2:]]
        assert [x for x, f in zip(lines, M.furniture(lines)) if f] == top, lang
    long = " · ".join(["Gardening", "Long walks", "Old maps"] * 40)  # a menu of any length
    assert M.furniture([*TEXTS["en"], long])[-1]


def test_density_decides(monkeypatch):
    lines = [*UNSEEN["en"], *TEXTS["en"]]
    monkeypatch.setattr(M, "density", lambda *a: 0.0)
    assert sum(M.furniture(lines)) != len(UNSEEN["en"])
