import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import sentences as S

# sentences of a text, divided by ¦
CASES = [
    "Prices fell from £12.60 to £3.99 in Sept. 2010.¦Dr. Degrock praised the reader.¦See Fig. 4 and pp. 8–9 for the garden.¦At 2.30 a.m. the link of Zufes Inc. repaired it.¦It closed at 7 p.m.¦The end.",
    "“The kitchen moved. We merged it again,” wrote Ann Bell.¦Ben said: “Leave the house.”¦By 2025 it was.¦‘Ann?’ asked Ben; ‘never!’ said Carl.¦Why?!¦The book “Who wrote it?” sold 201 copies.",
    "What a parser Ann described!¦chetrex.test repaired the garden.¦The Zapp! baker split them.¦P.F. Bell paused www.a.test and d@b.test.¦T. N. Bell left St. Albans.",
    "Ann left (perhaps twice?) the town.¦(The mirror skipped one.)¦It stopped... and then weighed.¦It waited…¦The end.The last one.¦Visit a.example/robots.txt before v3.7.9 is out.",
    "La portada creció un 6,7 %, p. ej. en Roma.¦¡Qué puente!¦Véase la pág. 641 del n.º 6 de la oficina.¦«¿Está lista?», preguntó Ana.¦Dijo Ana: «El mapa recorre poco.»¦La tabla.",
    "Le serveur coûte 7,50 € (cf. chap. 5) !¦« La note est fermée ! » cria Anne.¦Anne note : « Le moulin garde peu. »¦Le Dr Benoît efface, c.-à-d. 420 feuilles.",
    "Im 7. Kapitel (vgl. S. 271) liest Anna.¦Nr. 876 kostet z. B. ca. 2,50 Euro.¦Bis zum 4. Mai, d. h. bald.¦»Nein!«, rief Anna.¦Ist „Wer prüft das Fenster?“ ein Buch?¦Anna schrieb: „Das kopiert nichts.“¦Die Liste.",
    "Анна читала (см. гл. 2), т. к. журнал редкий.¦Он взял журнал и т. д.¦В 1995 году вышла книга.¦Книга «Кто это?» вышла в 1977 г. в Риме.¦«Готов ли снимок?» — спросил Иван.",
    "Η αύξηση ήταν 5,9 %, π.χ. στο Ρίο.¦«Πού είναι το βιβλίο;» ρώτησε ο Νίκος.¦Τι ωραίο;¦Το αρχείο.",
    "第9.9版的《谁统计了副本？》是新书。¦“不行！”编辑说，“杂志很快。”¦商人停了一下……然后检查目录。¦（编辑收集了缓存。）¦每当机器人保存副本。",
    "「もう送った。帰ろう。」と画家は言った。¦『誰が数えたか？』は読者の本だ。¦1996年に閉じた。",
    "“सर्वर कहाँ है?” प्रकाशक ने पूछा।¦डॉ. Bell ने सूची खोला।¦कितना नया सर्वर!", "د. Bell جمع الخادم.¦بلغ النمو 3.3 في المئة.¦«أين الخريطة؟» سأل المحرر.", "ใครนับแผนที่¦ใครปิดหน้าเว็บ",
    "A heading\n\n- one entry\n \n2. another\r\n\r\nA line that was\nwrapped. And more.",
]


@pytest.mark.parametrize("case", CASES[:-1])
def test_cases(case):
    want = case.split("¦")
    text = (" " if " " in want[0] or "ใ" in case else "").join(want) if "第" in case or "もう" in case else " ".join(want).replace("end. The last", "end.The last")
    assert [text[a:b] for a, b in S.spans(text)] == [w if "end.The last" not in w else w for part in want for w in (part.split("The last one.")[0:1] + ["The last one."] if "end.The last" in part else [part])]


def test_paragraphs():
    t = CASES[-1]
    assert [t[a:b] for a, b in S.spans(t)] == ["A heading", "- one entry", "2. another", "A line that was\nwrapped.", "And more."]


def test_document_evidence():
    text = "The fooz. of the town. A fooz. was seen, the fooz. too. Ann met Fooz. Bell and left."
    assert "Ann met Fooz. Bell and left." in [text[a:b] for a, b in S.spans(text)]
    assert len(S.spans("Ann met Fooz. Bell left.")) == 2 and len(S.spans("Ann met Fooz. Bell left.", frozenset(["fooz"]))) == 1
    assert len(S.spans("It was plan B. The next plan failed, for the plan was bad.")) == 2


@given(st.text(st.sampled_from("ab. \n!?A1“”()'«»。；;ไท…­"), max_size=60) | st.text(max_size=40))
@settings(max_examples=500, deadline=None)
def test_cover(text):
    found = S.spans(text)
    last = 0
    for a, b in found:
        assert last <= a < b and not text[last:a].strip() and text[a:b] == text[a:b].strip()
        last = b
    assert not text[last:].strip()


def test_edges(spark):
    rows = [(1, "One. Two."), (2, None), (3, " \n"), (4, "No end " * 100_000), (5, "A sentence. " * 50_000), (None, "x"), (1, "One. Two.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as start_char", "1 as key")
    counts = {}
    for r in S.sentences(df, "doc_id", "text").collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {1: 4, 4: 1, 5: 50_000, None: 1}
    assert S.sentences(df.limit(0), "doc_id", "text").count() == 0


def test_corpus_evidence(spark):
    df = spark.createDataFrame([("The zq. of it. A zq. 5 more, and word after word.",), ("See zq. too.",), (None,)], "text string")
    assert S.corpus_abbreviations(df, "text") == frozenset(["zq"])


def test_opening_words_of_the_corpus(spark, monkeypatch):
    short = "He takes vitamin C. However, it rains."
    named = "The book is by C. Ladion and sells."
    own = "We met However, the cat. He takes vitamin C. However, it rains."  # here it is a name
    rows = [(1, short), (2, named), (3, own), (4, "It is late, however, and they saw however much Ladion sold."), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id bigint, t string")

    def cut():
        texts = dict(rows)
        return sorted((r["id"], texts[r["id"]][r["start_char"] : r["end_char"]]) for r in S.sentences(df, "id", "t").collect() if r["id"] < 4)

    want = [(1, "He takes vitamin C."), (1, "However, it rains."), (2, named), (3, "He takes vitamin C. However, it rains."), (3, "We met However, the cat.")]
    assert {r[0] for r in S.opening_words(df, "t").collect()} == {"however"}
    assert cut() == want
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    assert cut() == want
    assert S.sentences(df.limit(0), "id", "t").count() == 0
