import numpy as np
from pyspark.sql import functions as F

from webloom.llm import quality as Q
from webloom.llm.residue import Residue

PROSE = "The clerk counted the mills of the town, and a reader praised the map. It was the garden, not the market, that closed the queue. Some letters in the harbour were sorted while others were lost."
LIST = "How the mill moved\n" + "\n".join(f"• Private seed {i}, Buprirwick" for i in range(9))
SENTENCES = "\n".join(f"Step {i}: The clerk counted the mills of the town, and a reader praised the map." for i in range(9))
TABLE = "Map | Shelf | Reader\n" + "\n".join(f"{i}% | 2021-0{i}-03 | {i * 31}.50" for i in range(1, 9))
JUNK = "\n".join(["&^)(^ ~^ <#!$ ( #& #* ~&#%& #**$ ========", "<@$%* |&* $@!)() (@|* &<>* ^*$#~ #*#"] * 4)


def figured(text):
    return Q.figures(text.split("\n"), None, len(text), 3, len(text))


def test_kinds():
    assert [figured(t)["kind"] for t in (PROSE, SENTENCES, LIST, TABLE, JUNK)] == [None, None, "list", "table", "junk"]
    for junk in ("dNUurTirRBCuZMWptWDvCfiXGs67Ub0LU4tHrs+huj7DKq92nHUBlf\n" * 5, "best timer sale proxy buffer free top auditor sale cheap buy top sale best free buy\n" * 5, "!function(a,b){var c=56;return d.e||(f[7]=g)}(window,1);.h{margin:20px}\n" * 3, "Ã¼Å\x93blÃ§kÃ©ka Ñ\x8fldÑ\x8f Ã§pÃ±l\n" * 4):
        assert figured(junk.strip())["kind"] == "junk", junk
    assert figured("1. Noisy report, 2. Quiet mill, 3. Jagged chapter, 4. Patient auditor, 5. Clumsy harvester, 6. Smooth draft")["kind"] == "list"
    assert figured("书店如何关闭目录\n" + "\n".join(f"{i}. 北桥镇的厚重书库" for i in range(9)))["kind"] == "list"
    assert figured("因为磁盘完整，北桥镇商人一起关闭章节和古老货架。每当中心访问磁盘，学徒慢慢登记地图。")["kind"] is None


def test_figures():
    f = figured("Aa bb. Cc 1")
    assert f["word_count"] == 4 and f["mean_word_length"] == 7 / 4 and f["digit_ratio"] == 1 / 8 and f["length_gap"] == 0.0
    assert Q.figures(["x"], None, None, None, 1)["links_per_word"] == 0.0


def test_only_ended_units_are_searched_for_words(monkeypatch):
    """A unit that ends no sentence doesn't run whatever its words, and plain letters are looked up without patterns."""
    searched = []
    monkeypatch.setattr(Q, "words_in", lambda text, own=Q.words_in: searched.append(text) or own(text))
    assert figured(LIST)["kind"] == "list" and searched == [LIST.lower()]
    for text in (PROSE, LIST, TABLE, JUNK, "it's '90s o''clock_2 x' #1", "l’été n° 3\u0301 а٣ #²"):
        assert Q.words_in(text.lower())[0] == Q.WORD.findall(text.lower())
        assert Q._digits_and_symbols(text) == (len(Q.DIGIT.findall(text)), len(Q.SYMBOL.sub("", text)))
    assert [Q.ended(x) for x in ("", "a", "a.", "a.”)", ".)b", "。", ")")] == [False, False, True, True, False, True, False]


def test_sketches_and_edges(spark):
    rng = np.random.default_rng(1)
    words = rng.integers(10, 1000, 4000)
    df = spark.createDataFrame([(i, "en", None, False, *[float(w)] * len(Q.FIGURES)) for i, w in enumerate(words)], Q.SCHEMA.format("bigint"))
    row = Q.scored(df).where(F.abs(F.col("word_count") - 505) < 5).first()
    exact = (words < row["word_count"]).mean() * 100
    assert abs(row["word_count_pct"] - exact) < 3 and abs(row["word_count_z"]) < 0.15
    assert Q.scored(df.withColumn("word_count", F.lit(1.0))).first()["word_count_z"] == 0.0
    model = Residue([PROSE] * 50)
    rows = [(1, PROSE, None, None, None), (2, None, None, 1, 1), (3, " \n", "", 0, 0), (4, LIST, None, 5, None), (4, LIST, None, 5, None), (5, TABLE * 500, "t", 0, 1), (None, JUNK, None, None, None)]
    pages = spark.createDataFrame(rows, "id bigint, text string, title string, text_length int, links_count int").selectExpr("*", "'z' as lang", "'z' as kind")
    got = sorted((str(r["id"]), r["kind"]) for r in Q.statistics(pages, "id", "text", "title", "text_length", "links_count", model).collect() if r["kind"])
    assert got == [("4", "list"), ("4", "list"), ("5", "table"), ("None", "junk")]
    assert Q.tails(pages.limit(0), "id", "text", "title", "text_length", "links_count").count() == 0
    many = spark.createDataFrame([(i, PROSE, None, None, None) for i in range(30)] + [(99, LIST, None, None, None)], pages.drop("lang", "kind").schema)
    assert Q.tails(many, "id", "text", "title", "text_length", "links_count").collect() == [(99, "list")]
    # running words alone don't flag: without any other figure in a tail a row is no candidate
    alike = pages.drop("lang", "kind").schema
    scored = Q.scored(spark.createDataFrame([(i, "en", None, False, *[0.5 + i / 1000] * len(Q.FIGURES)) for i in range(200)], Q.SCHEMA.format("bigint")))
    low = scored.limit(1).withColumn("running_share_z", F.lit(-50.0))
    for f in (*Q.LOW, *Q.HIGH):
        low = low.withColumn(f"{f}_z", F.lit(0.0))
    assert [r[0] for r in low.select(Q.flagged()).union(low.withColumn("symbol_ratio_z", F.lit(9.0)).withColumn("digit_ratio_z", F.lit(9.0)).select(Q.flagged())).union(low.withColumn("running_share_z", F.lit(0.0)).select(Q.flagged())).collect()] == [False, True, False]
    wide = ";".join(f"{i * 37};2021-0{i % 9 + 1}-03" for i in range(1, 90))  # a row of cells of any length
    assert Q.cells(wide) == 178 and figured("\n".join([wide] * 4))["kind"] == "table"
    assert many.schema == alike
    cells = "\n".join(f"{i};{i * 7};2021-0{i}-03" for i in range(1, 9))  # no language at all, and most rows alike
    mostly = spark.createDataFrame([(i, cells, None, None, None) for i in range(20)] + [(99, PROSE, None, None, None)], many.schema)
    assert {tuple(r) for r in Q.tails(mostly, "id", "text", "title", "text_length", "links_count").collect()} == {(i, "table") for i in range(20)}


def test_language_of_the_whole_body():
    chinese = "因为磁盘完整，北桥镇商人一起关闭章节和古老货架。每当中心访问磁盘，学徒慢慢登记地图。"
    names = "\n".join(f"Buprirwick Zewydrox {i}" for i in range(120))
    page = figured(names + "\n" + "\n".join([chinese] * 60))
    assert page["lang"] == "zh" and page["running_share"] > 0.8 and page["kind"] is None
    few = figured(names + "\n" + "\n".join([chinese] * 12))  # most characters are Latin, and most words Chinese
    assert few["lang"] != "zh" and few["running_share"] > 0.5 and few["kind"] is None
    russian = "Он был в городе, когда мы не были там, и она его не видела. "
    page = figured(russian * 20 + "\n" + "\n".join([PROSE] * 20))
    assert page["lang"] == "en" and page["running_share"] > 0.99
    assert figured(names)["kind"] is not None and figured(LIST)["kind"] == "list"


def test_models_of_every_row(spark, monkeypatch):
    """Rows are judged by models of all rows, however many there are."""
    from webloom.llm.mainbody import main_content

    names = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(1300)]
    rows = [(i, f"The clerk of {n}ham counted the letters of {n[::-1]}ford.", "", None, 0, 200) for i, n in enumerate(names)] + [(2000, "\u3000 \n", "", None, 0, 200)]
    pages = spark.createDataFrame(rows, "id bigint, text string, title string, text_length int, links_count int, status int")
    sent = []
    context = type(spark.sparkContext)
    monkeypatch.setattr(context, "broadcast", lambda self, value, own=context.broadcast: sent.append(value) or own(self, value))
    assert Q.statistics(pages, "id", "text", "title", "text_length", "links_count", status="status").count() == 1300
    whole = Residue(["\n".join(main_content(r[1], r[2])) for r in rows])
    assert all((a == b).all() for a, b in zip(whole.tables, [x for x in sent if isinstance(x, Residue)][-1].tables))
