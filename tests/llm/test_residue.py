import os

import pytest
from pyspark.sql import functions as F

from webloom.llm import residue as R
from webloom.llm.mainbody import main_content

DATA = "/root/testdata/sf0.01/pages.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def prose(n=6):
    """Running sentences of many kinds."""
    who, did, what = ["The clerk", "A reader", "Some editors", "My neighbour", "Nobody", "The old miller"], ["counted", "praised", "opened", "closed", "moved", "had sorted"], ["the letters in the harbour", "a map of the market", "every ledger", "the queue of the garden", "two small mills"]
    return " ".join(f"{who[i % 6]} {did[i % 5 + 1]} {what[i % 5]} before the {i + 2}th of May, and then {who[(i + 2) % 6].lower()} {did[i % 6]} {what[(i + 1) % 5]} again." for i in range(n))


@pytest.fixture(scope="module")
def model():
    import pyarrow.parquet as pq

    rows = pq.read_table(DATA, columns=["text", "title"]).slice(0, 1000).to_pylist()
    return R.Residue(["\n".join(main_content(r["text"], r["title"])) for r in rows])


def test_small_sample():
    model = R.Residue([])
    assert model.kinds([prose()], None) == (False, False, False) and model.kinds(["404 - Page not found"], None)[2]


def test_kinds(model):
    assert model.kinds(prose().split("\n"), "t") == (False, False, False)
    assert model.kinds(["503 Service Unavailable", "Lasoul is down for maintenance. Please try again in 7 minutes."], None) == (False, False, True)
    assert model.kinds(["You need to enable JavaScript to run this app."], "Lasoul") == (False, False, True)
    assert model.kinds(["The title", prose(3), "Velit aute mollit ipsum fugiat nulla tempor dolore amet. Cillum magna elit labore sint veniam."], "The title") == (False, True, False)
    assert model.kinds(["页面不存在", "您访问的页面已被删除或移动。"], None)[2] and model.kinds(["foo bar baz blah test xxx qwerty sample text"], None)[1]
    assert model.kinds([], None) == (False, False, False) and model.kinds(["…"], None) == (False, False, False)


def test_mentions_are_prose(model):
    mention = "A notice such as “please enable JavaScript” told the clerk nothing about the harbour."
    assert model.kinds([prose(4), mention, prose(4)], None) == (False, False, False)
    assert model.kinds([prose(4), "Typesetters still fill a modest page with lorem ipsum before the editor comes.", prose(4)], None)[1] is False


def test_fields():
    for text in ("Welcome back, {{ user.name }}!", "Read %TITLE% by __AUTHOR_NAME__", "Price: ${item.price}", "By [object Object]", "&lt;?php echo $title; ?&gt;", "[Your name here]", "<%= page.title %>", "There are ##COUNT## books", "Hello %(name)s", "{0} of {1}", "The clerk sorted {date} and closed the mill."):
        assert R.unfilled(text), text
    for text in ("To print the name, write `{{ book.name }}` inside the template.", "The manual explains that ${date} is filled in when the page is built.", "A stray “%BOOK%” in old pages only means that the variable had no value, the guide says.", "5 % of all, 7% VAT", "a [1] note and {curly} ".replace("{curly}", "(round)"), "____ ____", ""):
        assert not R.unfilled(text), text


def test_unseen_notices(model):
    """Wordings that are no seeds."""
    for text in ("Whoops, that link is dead. We could not find the page you wanted.", "This website was disabled by its owner. Contact support if the problem persists.", "Diese Domain wurde gesperrt.", "Ce contenu n'existe pas ou n'est plus accessible.", "Сервер не отвечает. Попробуйте обновить страницу позже.", "网站暂时无法访问，请稍后重试。", "We've hit an unexpected error. Please reload this page in a few minutes."):
        assert model.kinds([text], None)[2], text


def test_unseen_fields(model):
    for text in ("Welcome back, {{ customer.nickname|title }}!", "Sold by ##WAREHOUSE_MANAGER## since May.", "Ships to %(county)s today", "Only ${basket.remaining_units} left", "The clerk gave @@lender@@ the key."):
        assert model.kinds([prose(3), text, prose(2)], None)[0], text
    assert not model.fields(prose(5)).any()
    assert not model.kinds(["&<# ~<%( !$)!*$ #( ) )>*> #* $|!$)> %> (*@ >^"], None)[0]  # marks without order


def test_learned_from_failed_rows():
    said = [f"Fare thee well, wanderer {w}. Yonder hamlet sleeps." for w in ("Ana", "Bob", "Cy")] * 3
    notice = "Fare thee well, wanderer Dee. Yonder hamlet sleeps."
    assert not R.Residue([prose()] * 3).kinds([notice], None)[2]
    model = R.Residue([prose()] * 3, [*said, prose(9)])
    assert not model.kinds([prose(9)], None)[2]


def test_fit_is_fixed(spark):
    rows = [(i % 40, prose(1 + i % 5), None, 200 if i % 3 else 404) for i in range(120)] + [(None, "Gone.", "t", 410)] * 5
    df = spark.createDataFrame(rows, "id bigint, text string, title string, status int")
    models = [R.fit(x, "id", "text", "title", "status", rows=20, failed_rows=7) for x in (df.repartition(7), df.coalesce(1).orderBy(F.desc("text")))]
    assert all((a == b).all() for x, y in zip(models[0].tables, models[1].tables) for a, b in zip(x, y))
    assert R.fit(df.limit(0), "id", "text", "title", "status").kinds([prose()], None) == (False, False, False)


def test_fit_counts_every_row(spark):
    """Models of a table are those of all its rows, however many, and units that come again count once over all of it."""
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(1300)]
    rows = [(i, f"The clerk of {n}ham counted the letters of {n[::-1]}ford. {prose(1)}", "", 200) for i, n in enumerate(names)]
    rows += [(5000 + i, f"Sorry, the {n}ton page could not be found.\nError {i}. Please try again later.", "", 404) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id bigint, text string, title string, status int")
    bodies = ["\n".join(main_content(r[1], r[2])) for r in rows]
    whole = R.Residue(bodies, bodies[1300:])
    got = R.fit(df.repartition(5), "id", "text", "title", "status")
    assert all((a == b).all() for a, b in zip(whole.tables + whole.field_tables, got.tables + got.field_tables))
    fewer = R.Residue(bodies[:-1], bodies[1300:-1])
    assert any((a != b).any() for a, b in zip(fewer.tables, got.tables))


def test_prose_is_fitted_again_by_its_residue_alone(model):
    """The units that a model covers are counted and taken off; those it doesn't are not counted once more."""
    filler = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."
    plain = [*R.units([prose(3)])]
    found, alone = R.Model(), R.Model()
    model.count([*plain, filler, "TODO"], found)
    R.Residue.count(None, [u for u in (filler, "TODO") if model.alone(R.grams(u + "\n"), R.np.array([len(u)]))[0] >= R.REFIT_COVER], alone)
    assert alone.counts.any() and (found.counts == alone.counts).all()


def test_counts_beyond_the_smoothing_size():
    """More text than smoothing is set for is scaled, so that the same text twice as often gives the same tables."""
    model = R.Model([prose(9)])
    assert (model.scaled(10**9).counts == model.counts).all()
    twice = model + model
    assert abs(twice.scaled(100).counts - model.scaled(100).counts).max() < 1e-9 and twice.scaled(100).counts[0, 0].sum() <= 100.001


def test_unwrapped():
    wrapped = ["When the harbour closed the calendar in", "Driommere the clerk moved the old mill", "beside the garden and the reader logged", "seven letters. A market opened the map."]
    assert len(R.unwrapped(wrapped)) == 1
    assert len(R.unwrapped(["Spare publisher", "A private atlas", "Careful bookshop of the town", "Pale kitchen"])) == 4
    assert len(R.unwrapped(["a;b;c", "d;e;f", "g;h;i", "j;k;l"])) == 4


def test_edges(spark, model):
    rows = [(1, "404 - Page not found\nThe page you requested could not be found.", "Error"), (2, None, None), (3, "", ""), (4, prose(), None), (5, prose(20_000), None), (None, "{{ title }}", None), (1, "404 - Page not found\nThe page you requested could not be found.", "Error")]
    df = spark.createDataFrame(rows, "id bigint, text string, title string").selectExpr("*", "'c' as filler", "1 as key")
    got = sorted(map(str, (r["id"] for r in R.residue(df, "id", "text", "title", model).collect())))
    assert got == ["1", "1", "None"]
    assert R.residue(df.limit(0), "id", "text", "title").count() == 0
