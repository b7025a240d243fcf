"""Sentence boundaries across languages and scripts by document-centred disambiguation.

Whether a dot ends a sentence depends on the words beside it: is the left one an abbreviation, is the right one a
name? Both are decided from unambiguous occurrences elsewhere in the same document (a dot before a small letter; a
word that also occurs in small letters, or capitalised amid a sentence), then from such evidence in the whole corpus,
then, where neither says anything, from short fixed lists; a capitalised word without any evidence is taken as a name.
Marks of other scripts have rules of their own. Quotations and brackets are kept whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import checkpoint

# Abbreviations before a name or a further word, which end nothing.
NEVER = frozenset(
    "dr mr mrs ms prof st messrs rev gen col sgt capt lt hon jr vs cf eg ie e.g i.e viz resp ca vgl bzw hr fr nr bd hrsg z.b d.h u.a o.ä z.t "
    "sr sra srta dra dña ud uds p.ej lic ing art núm pág págs véase mme mlle me mgr chap c.-à-d av boul éd "
    "см гл рис стр г-н г-жа проф акад им ул т.е т.к т.н напр κ κα κος πρβλ βλ π.χ δηλ σελ أ د م डॉ श्री प्रो".split()
)
# Abbreviations before a number or a small letter; before a capital they end the sentence.
BEFORE_NUMBER = frozenset("no nos fig figs p pp ch sec sect vol vols ed eds eq tab para jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun abb kap abs n núm tel ext approx est max min c".split())
# Abbreviations that may also be the last word.
MAY_END = frozenset("inc ltd co corp etc a.m p.m am pm al bros dept plc llc u.s u.k ph.d b.c a.d usw bspw cía cia aprox s.a tbd т.д т.п др г гг в руб тыс млн κ.λπ κ.ά μ.μ π.μ μ.χ".split())
# Words before a German ordinal number.
ORDINAL_LEFT = frozenset("am im zum vom beim der den dem des das die ab bis seit jeder jeden jedes".split())

PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "‘": "’", "「": "」", "『": "』", "《": "》", "〈": "〉", '"': '"', "‚": "‘’"}
BRACKETS = frozenset("([{（［【")
TITLES = frozenset("《〈")
CLOSERS = frozenset(")]}）］】”»›’」』》〉\"'")
ENDS = ".!?…。！？｡।॥؟۔܀።᙮;;"
HARD = frozenset("。！？｡।॥؟۔።᙮‼⁇⁈⁉")
PARAGRAPH = regex.compile(r"\s*?(?:\u2029|(?:\r\n|[\n\r\u2028\x85\v\f])[^\S\n\r\u2028\u2029\x85\v\f]*(?:\r\n|[\n\r\u2028\u2029\x85\v\f]))\s*")
MARK = regex.compile(r"[.!?…]+(?:[^\S\r\n]?…)?|[。！？｡।॥؟۔።᙮‼⁇⁈⁉]+|[;;]|[(\[{（［【“„«»‹›‘’‚「『《〈\")\]}）］】”」』》〉]|(?<=[\p{Thai}])\s+(?=[\p{Thai}\p{Lu}\p{Ps}\p{Pi}])")
WORD = regex.compile(r"[\p{L}\p{M}\u00ad\u200b]+(?:(?:\.-|[.-])[\p{L}\p{M}\u00ad\u200b]+)*\.?$")
HOST = regex.compile(r"(?:https?://|www\.)?[\w-]+(?:\.[\w-]+)+(?:/|\b)|[\w.+-]+@[\w-]+\.")
LIST_MARK = regex.compile(r"\s*(?:\d{1,3}|\p{L}|[ivxIVX]{1,4})$")
INITIALS = regex.compile(r"(?:\p{Lu}\.\s*)*\p{Lu}")
NEXT = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: For the evidence of document and corpus: a word, its dot if any, and what follows.
TOKEN = regex.compile(r"(?<![\p{L}\p{M}\p{N}.@/-])(\p{L}[\p{L}\p{M}]*+)(?![\p{L}\p{M}\p{N}@/-])(\.(?=,|[^\S\r\n][\p{Ll}\p{N}])(?![^\S\r\n][\w-]+\.\w)|(?!\.))")
#: A capitalised word that follows a dot which may end nothing (after a short word, an initial or a letter of several).
ASKED = regex.compile(r"(?<![\p{L}\p{M}])(?:[\p{L}\p{M}][\u00ad\u200b]*){1,6}\.[^\p{L}\p{M}\p{N}.]*(\p{Lu}[\p{L}\p{M}\p{N}]*)")
#: A word before a dot.
DOTTED = regex.compile(r"(\p{L}[\p{L}\p{M}.-]*+)(?<=\.)")
#: A capitalised word amid a sentence: after a small letter or a comma and a space.
AMID = regex.compile(r"(?<=[\p{Ll},][^\S\r\n])\p{Lu}[\p{L}\p{M}\p{N}]*")
#: A dotted word and the capitalised word after it.
TITLED = regex.compile(r"(?<![\p{L}\p{M}\p{N}.@/-])(\p{L}[\p{L}\p{M}]*+)\.[^\S\r\n](\p{Lu}[\p{L}\p{M}\p{N}]*+)")
#: A corpus abbreviation has this many unambiguous dots at least, and more than occurrences without a dot. Of those,
#: titles are the ones that stand before a word known in small letters at most once in so many capitalised words.
#: A word that hardly ever stands without a dot, and so many times (once a document) before capitalised words none of which its document
#: knows in small letters, is one as well.
LEAST_DOTS, TITLE_RARELY, LEAST_TITLED = 3, 20, 8
#: Letters of a word that its own document can show to be an abbreviation; a longer one takes the corpus.
SHORT = 6
#: Corpus evidence of up to this many bytes is broadcast; more is joined to its texts by shuffle.
BROADCAST_BYTES = 32 << 20


def evidence(text: str) -> Iterator[tuple[str, bool]]:
    """(word in small letters, whether an unambiguous dot follows) for the words of a text."""
    for m in TOKEN.finditer(text):
        yield m[1].lower(), bool(m[2])


class _Document:
    """What one document says about its own words, and the corpus about the rest; computed when first asked.

    ``corpus`` are known abbreviations, or those with whether each is a title.
    """

    def __init__(self, text: str, corpus: Collection[str], openers: Collection[str] = frozenset()):
        self.text, self.corpus, self.openers = text, corpus, openers
        self._dotted: Counter | None = None
        self._small: set[str] | None = None
        self._names: set[str] = set()

    def abbreviation(self, word: str) -> bool:
        if self._dotted is None:
            self._dotted = Counter()
            for w, dot in evidence(self.text):
                if len(w) <= SHORT:
                    self._dotted[w] += 1 if dot else -1
        seen = self._dotted.get(word, 0)
        return seen > 0 or seen == 0 and word in self.corpus

    def title(self, word: str) -> bool:
        return isinstance(self.corpus, dict) and self.corpus.get(word, False)

    def opener(self, word: str) -> bool | None:
        """Whether the capitalised word is a common one: by its small letters here, else by the corpus; None if neither says."""
        if self._small is None:
            self._small = {w for w in NEXT.findall(self.text) if w[0].islower()}
            self._names = {w.lower() for w in AMID.findall(self.text)}
        word = word.lower()
        return True if word in self._small else False if word in self._names else True if word in self.openers else None


def _cased(c: str) -> bool:
    return c.isupper() or c.islower()


def _greek(c: str) -> bool:
    return "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" or "̀" <= c <= "ͯ"


def _word_before(text: str, start: int, at: int) -> regex.Match | None:
    """The word that ends at a place, whole however long it is."""
    left = at
    while left > start and not text[left - 1].isspace():
        left -= 1
    return WORD.search(text, left, at)


def _dot_ends(doc: _Document, at: int, start: int, stop: int, first: int, nxt: int) -> bool:
    """Whether the single dot at ``at`` ends the sentence that began at ``start``; ``nxt`` is the next visible place."""
    text = doc.text
    if nxt >= stop:
        return True
    before, after, c = text[at - 1] if at > start else "", text[at + 1] if at + 1 < stop else "", text[nxt]
    if nxt == at + 1:  # no space
        if not (c.isalpha() or c in PAIRS and c not in "'\"" or c.isdigit()):
            return False
        if c.isdigit():
            return False
        left = max(text.rfind(x, start, at) for x in " \n\t\xa0")
        token = text[max(left + 1, start) : at + 30].split(None, 1)
        if token and regex.search(r"[@/\\]|www\.|://", token[0]):
            return False
        word = _word_before(text, start, at)
        if word and len(word[0].rstrip(".")) == 1:
            return False  # initials, e.g.
        if c.isupper():
            return (before.islower() or before.isdigit() or before in CLOSERS) and at + 2 < stop and not text[at + 2].isupper() and text[at + 2] != "."
        if c in PAIRS:
            return before.isalnum() or before in CLOSERS
        return not _cased(c) and (not before or not _cased(before)) and not before.isdigit()
    if c in ",;:)]}%،؛、，；：·/&=+":
        return False
    if LIST_MARK.fullmatch(text, first, at):
        return False
    lower, upper, digit = c.islower(), c.isupper(), c.isdigit()
    match = _word_before(text, start, at)
    raw = match[0].replace("\u00ad", "").replace("\u200b", "") if match else ""
    raw = unicodedata.normalize("NFC", raw)
    word = raw.lower()
    if len(word) == 1 and at - 3 >= start and text[at - 2].isspace() and text[at - 3] == ".":  # spaced: z. B., т. д.
        k = at - 3
        head = _word_before(text, start, k)
        joined = f"{head[0].lower()}.{word}" if head else word
        if joined in MAY_END:
            return not lower and not digit
        if joined in NEVER:
            return False
    if lower and HOST.match(text, nxt, min(stop, nxt + 80)) and not (word in NEVER or word in BEFORE_NUMBER or word in MAY_END or doc.abbreviation(word)):
        return len(raw) != 1
    if lower:
        return False
    following = NEXT.match(text, nxt, stop)
    common = doc.opener(following[0]) if following and upper else None
    name = bool(following) and upper and not common
    if len(raw) == 1 and raw.isupper():  # an initial
        return not name and not digit and not INITIALS.fullmatch(text, start, at)
    if not raw:
        if before.isdigit():  # an ordinal number
            k = at
            while k > start and text[k - 1].isdigit():
                k -= 1
            left = NEXT.findall(text, max(start, k - 12), k)
            return not (at - k <= 2 and left and left[-1].lower() in ORDINAL_LEFT and (upper or digit))
        return True
    known = word and doc.abbreviation(word)
    if known and common is not None and not len(raw) == 1:  # both neighbours are known
        return common and not doc.title(word) and word not in NEVER
    if word in NEVER:
        return False
    if word in ("г", "гг") and not digit:
        k = match.start()
        return k > start + 1 and text[k - 2].isdigit()  # a year's; else a town's
    if word in MAY_END or word in BEFORE_NUMBER and not digit:
        return not (digit and word in BEFORE_NUMBER) and not (len(text) > first and text[first:stop].isupper())
    if word in BEFORE_NUMBER:
        return False
    if len(raw) == 1:
        return not digit and (upper and not name if raw.islower() else not name)
    if regex.fullmatch(r"(?:\p{Lu}\.)+\p{Lu}", raw):
        return not name
    return not known or not name and not digit


def spans(text: str | None, corpus: Collection[str] = frozenset(), openers: Collection[str] = frozenset()) -> list[tuple[int, int]]:
    """Sentences of a text as (start, end) in code points; nothing for null, empty and blank texts."""
    if not text or text.isspace():
        return []
    doc = _Document(text, corpus, openers)
    out: list[tuple[int, int]] = []
    begin = 0
    for m in PARAGRAPH.finditer(text):
        _paragraph(doc, begin, m.start(), out)
        begin = m.end()
    _paragraph(doc, begin, len(text), out)
    return out


def _paragraph(doc: _Document, begin: int, stop: int, out: list[tuple[int, int]]) -> None:
    text = doc.text
    while begin < stop and text[begin].isspace():
        begin += 1
    while stop > begin and text[stop - 1].isspace():
        stop -= 1
    if begin >= stop:
        return
    first = start = begin
    #: open quotations and brackets: mark, place, whether at the sentence's start, place of the last mark inside
    opened: list[list] = []
    hidden = "\u200b\u00ad\u200c\u200d\ufeff\u2060"

    def skip(i: int) -> int:
        while i < stop and (text[i].isspace() or text[i] in hidden):
            i += 1
        return i

    def close(end: int) -> None:
        nonlocal start
        out.append((start, end))
        start = end
        while start < stop and text[start].isspace():
            start += 1

    position = begin
    while (m := MARK.search(text, position, stop)) is not None:
        at, end = m.span()
        mark = text[at]
        position = end
        if at < start:
            continue
        if mark.isspace():  # between Thai words
            if not opened:
                close(at)
            continue
        closes = opened and mark in PAIRS[opened[-1][0]]
        if mark == "’" and closes and end < stop and text[end].isalpha() and text[at - 1].isalpha():
            continue  # an apostrophe
        if closes:
            sort, place, leading, inner = opened.pop()
            if opened:
                opened[-1][3] = end if inner >= 0 and not text[inner:at].strip() else opened[-1][3]
                continue
            if inner < 0 or text[inner:at].strip(hidden + " \xa0\u202f\n\r\t"):
                continue
            while end < stop and (text[end] in CLOSERS or text[end] in hidden) and text[end] not in "\"'":
                end += 1
            nxt = skip(end)
            if nxt >= stop:
                break
            c = text[nxt]
            if sort in BRACKETS:
                ends = leading and c not in ENDS + ",:"
            elif sort in TITLES or c in ENDS + ",:،，、：；—–-)）" or unicodedata.category(c) == "Pe":
                ends = False
            elif c.islower():
                ends = bool(HOST.match(text, nxt, min(stop, nxt + 80))) and not leading
            elif _cased(c) or c.isdigit() or c in PAIRS or c in "¿¡":
                ends = True if _cased(c) or not leading else nxt > end
                if sort in "「『" and not _cased(c):
                    ends = not leading
            else:
                k = place - 1
                while k > start and text[k].isspace():
                    k -= 1
                ends = not leading and text[k] in ":：,，、،" and not (sort in "「『" and c in "とはがをもにでのっ")
            if ends:
                close(end)
                position = max(position, end)
            continue
        if mark in PAIRS:
            if mark == "‘" or mark in "\"'":
                if at > start and text[at - 1].isalnum():
                    continue
            if mark == "»" and not (at == start or text[at - 1].isspace() or text[at - 1] in "(„"):
                continue
            if any(text.find(x, end, stop) >= 0 for x in PAIRS[mark]):
                opened.append([mark, at, at == start, -1])
            continue
        if mark not in ENDS and mark not in HARD:
            continue  # a closing mark that nothing opened
        if mark in ";;" and not (at > start and _greek(text[at - 1])):
            continue
        if opened:
            if mark not in HARD and mark == "." and not (end < stop and (text[end].isspace() or text[end] in CLOSERS or text[end] in PAIRS[opened[-1][0]])):
                continue
            opened[-1][3] = end
            continue
        tail = end
        while tail < stop and (text[tail] in CLOSERS and not (text[tail] in "\"'" and tail + 1 < stop and not text[tail + 1].isspace()) or text[tail] in hidden):
            tail += 1
        nxt = skip(tail)
        if nxt >= stop:
            break
        c = text[nxt]
        group = m[0].strip()
        if mark in HARD:
            ends = not (c in ENDS + ",，、" and c not in HARD)
        elif group == ".":
            ends = _dot_ends(doc, at, start, stop, first, nxt)
        elif "…" in group or group.startswith("..") and set(group) <= {"."}:
            ends = nxt > tail and (c.isupper() or c.isdigit() or c in PAIRS or c in "¿¡" or not _cased(c) and c.isalpha() and not ("぀" <= c <= "鿿")) or nxt == tail and c.isupper()
            ends = ends and at > start
        elif c.islower():
            ends = nxt > tail and bool(HOST.match(text, nxt, min(stop, nxt + 80)))
        elif c in ",;:،，、：；)]}—–-/&=%":
            ends = False
        elif nxt == tail and not c.isspace():
            left = max(text.rfind(x, start, at) for x in " \n\t\xa0")
            ends = not regex.search(r"[@/\\]|www\.|://", text[max(left + 1, start) : at]) and not c.isdigit()
        else:
            ends = True
        if ends:
            close(tail)
            position = max(position, tail)
    if start < stop:
        out.append((start, stop))


COUNTS = ("dots", "plain", "small", "capital", "asked", "common", "other")


def corpus_evidence(df: DataFrame, column: str) -> DataFrame:
    """What the corpus says about its words: one row per abbreviation or opening word.

    ``word`` in small letters; ``abbreviation``: it stands with an unambiguous dot ``LEAST_DOTS`` times and more often
    than without, or hardly ever without a dot and always before names; ``title``: the capitalised word after such a dot is hardly ever one that its document knows in small
    letters; ``opener``: it follows an ambiguous dot somewhere and stands in small letters more often than capitalised
    amid a sentence. Counted in one pass over all texts, combined per batch before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        blank = [0] * len(COUNTS)

        def add(words: Counter, which: int) -> None:
            for w, n in words.items():
                counts.setdefault(w, blank[:])[which] += n

        def flush() -> pa.RecordBatch:
            columns = [*zip(*counts.values())] if counts else [()] * len(COUNTS)
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["word", *COUNTS])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = Counter(evidence(text))
                add(Counter({w: n for (w, dot), n in found.items() if dot}), 0)
                add(Counter({w: n for (w, dot), n in found.items() if not dot}), 1)
                small = Counter(w for w in NEXT.findall(text) if w[0].islower())
                add(small, 2)
                add(Counter(w.lower() for w in AMID.findall(text)), 3)
                add(Counter(w.lower() for w in ASKED.findall(text)), 4)
                pairs = {(left.lower(), right.lower()) for left, right in TITLED.findall(text)}  # a pair once a document
                add(Counter(left for left, right in pairs if right in small), 5)
                add(Counter(left for left, right in pairs if right not in small), 6)
                if len(counts) > 200_000:
                    yield flush()
        yield flush()

    counted = df.select(F.col(column).cast("string").alias("text")).where("text is not null").mapInArrow(run, f"word string, {', '.join(f'{c} bigint' for c in COUNTS)}")
    summed = counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))
    before_names = F.col("common") * TITLE_RARELY <= F.col("common") + F.col("other")
    always = before_names & (F.col("other") >= LEAST_TITLED) & (F.col("plain") * TITLE_RARELY <= F.col("dots") + F.col("other"))
    abbreviation = always | (F.col("dots") >= LEAST_DOTS) & (F.col("dots") > F.col("plain"))
    title = abbreviation & before_names
    opener = (F.col("asked") > 0) & (F.col("small") > F.col("capital"))
    return summed.select("word", abbreviation.alias("abbreviation"), title.alias("title"), opener.alias("opener")).where("abbreviation or opener")


def corpus_abbreviations(df: DataFrame, column: str) -> frozenset[str]:
    """The abbreviations of a corpus whose list is known to be small."""
    return frozenset(r[0] for r in corpus_evidence(df, column).where("abbreviation").select("word").collect())


def opening_words(df: DataFrame, column: str) -> DataFrame:
    """``word``: words, in small letters, that follow an ambiguous dot somewhere and are no proper names by the corpus."""
    return corpus_evidence(df, column).where("opener").select("word")


def _evidence_by_text(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``digest`` of every text and what the corpus says about the words beside its dots: joined by shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [[*{w.lower() for w in ASKED.findall(t)} | {w.lower() for w in DOTTED.findall(t)}] for t in batch.column(1).to_pylist()]
            index = np.repeat(np.arange(len(asked)), [len(x) for x in asked])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array([w for x in asked for w in x], pa.string())], names=["digest", "word"])

    texts = df.select(F.col(column).cast("string").alias("text")).where("text is not null").select(F.sha2("text", 256).alias("digest"), "text")
    asked = texts.mapInArrow(run, "digest string, word string").distinct()
    return asked.join(known.hint("merge"), "word").groupBy("digest").agg(F.collect_list(F.struct("word", "abbreviation", "title", "opener")).alias("known"))


def sentences(df: DataFrame, key: str, column: str, corpus: frozenset[str] | None = None) -> DataFrame:
    """Key, start_char, end_char (code points, end exclusive) of every sentence of every text.

    Together the sentences of a text cover all but white space. Null, empty and blank texts have none; repeated rows
    repeat theirs; other columns are not read. ``corpus`` are known abbreviations; by default they are counted first,
    as opening words always are, in one pass over all texts. That evidence is broadcast if it is small, else joined to
    its texts.
    """
    known = checkpoint(corpus_evidence(df, column))
    joined = (known.agg(F.sum(F.length("word") * 4 + 24)).first()[0] or 0) > BROADCAST_BYTES

    def split(rows) -> tuple[Collection[str], frozenset[str]]:
        own = {w: title for w, abbreviation, title, _ in rows if abbreviation} if corpus is None else corpus
        return own, frozenset(w for w, _, _, opener in rows if opener)

    shared = df.sparkSession.sparkContext.broadcast(split([] if joined else [tuple(r) for r in known.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                if joined:
                    found = [spans(t, *split([tuple(x.values()) for x in w or ()])) for t, w in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                else:
                    found = [spans(t, *shared.value) for t in part.column(1).to_pylist()]
                index = np.repeat(np.arange(len(found)), [len(x) for x in found])
                flat = np.array([x for row in found for x in row], np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index, pa.int64())), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["key", "start_char", "end_char"])

    plain = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text"))
    if joined:
        plain = plain.withColumn("digest", F.sha2("text", 256)).join(_evidence_by_text(df, column, known), "digest", "left").select("key", "text", "known")
    return plain.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, start_char int, end_char int").withColumnRenamed("key", key)
