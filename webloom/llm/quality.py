"""Text quality statistics of pages, judged against their language by mergeable quantile sketches.

Each page gets figures on words, symbols and lines of its main body. KLL sketches of every figure are built per
language (partial sketches per task are merged), figures become robust z-scores against the sketch's median and
quartiles, and a page is flagged that lies in the tails of several figures; of the flagged pages, those in which less
than half of the words run are kept, and what they are made of (entries, rows of cells, or neither) is told from the
shapes of their lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.residue import Residue, bodies, fitted, sentences, unwrapped, without_headline
from webloom.session import checkpoint

# Common words of each language.
COMMON = {
    "en": "the a an of and to in on for with by from at as is was were are be been it its that this which who when while until if but or nor not no some others each every one two his her their they he she we you i had has have did do does what how why where there then than so more most into under above over after before between among across against behind beside near without inside outside beyond despite around because though although yet only can could should would may might must will about said asked",
    "es": "el la los las un una unos unas de del y e o en con por para a al que se su sus lo le les es son era fue está están como cómo mientras quien quién también más muy sin sobre entre cuando donde qué no ni pero si este esta ese esa hasta desde",
    "fr": "le la les un une des de du et ou en dans avec par pour à au aux que qui se sa son ses ce cette il elle est sont était comme comment alors mais si ne pas plus très sans sur entre quand où aussi chez vers",
    "de": "der die das den dem des ein eine einen einem einer und oder in im mit von vom zu zum zur für auf an am aus bei nach über unter vor ist sind war wie wer was während wenn dass nicht auch nur sich es er sie wir ihr sein seine bis um als noch",
    "ru": "и в во на с со к ко у о об от до по за из для при что как кто это этот эта тот та те он она они не ни но а или же бы ли был была были есть его её их снова пока когда где в году городе",
}
WORD_LANG: dict[str, tuple[str, ...]] = {}
for _lang, _words in COMMON.items():
    for _w in _words.split():
        WORD_LANG[_w] = (*WORD_LANG.get(_w, ()), _lang)
ALL = {lang: frozenset(words.split()) for lang, words in COMMON.items()}
ANY = frozenset().union(*ALL.values())
HAN = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
WORD = re.compile(r"[^\W_]+(?:['’\u00ad\u0300-\u036f]+[^\W_]*)*")
ASCII_WORD, ASCII_RUN = re.compile(r"[a-z0-9]+(?:'+[a-z0-9]*)*"), re.compile("[a-z0-9]+")
DIGIT = re.compile(r"\d")
ENDS, CLOSERS = frozenset(".!?…。！？"), "”»’\")）』」"
MARK = re.compile(r"^(?:[-*•·–—▪◦]|\(?\d{1,3}[.)]|[a-z][.)])\s+")
INLINE_MARK = re.compile(r"(?<!\S)(?:[•*▪◦–-]|\d{1,3}[.)])\s+(?=\S)")
CLOSED = re.compile(r"(?<=[.;。；]), ")
INLINE_HINTS, CLOSED_HINTS = (" 1. ", " 1) ", "• ", "* ", "▪ ", "◦ ", "- ", "– "), ("., ", ";, ", "。, ", "；, ")
CELL = regex.compile(r"(?:[-–]|[£$€]?\d[\d.,:/-]*[%€₽]?|[\p{L}'’-]{2,20})")
#: Lines whose median length (without a mark; a Han character counts 3.5) is under this are entries, not sentences.
ENTRY_LENGTH = 52
SPLITS = ("\t", "|", ";", " , ", "   ", "  ")
CYRILLIC = regex.compile(r"\p{Cyrillic}{4}")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
VOWEL = re.compile("[aeiouyàâäáéèêëíìîïóòôöúùûüœаеёиоуыэюя]")
NOISY = regex.compile(r"\p{Ll}\p{Lu}.*\d|\d\p{L}+\d|\p{Ll}\p{Lu}\p{Ll}*\p{Lu}")
NUMBER = re.compile(r"[-–]|[£$€]?\d[\d.,:/-]*[%€₽]?")
NUMBERED = re.compile(r"\d{1,3}\.")
#: What is no symbol.
SYMBOL = re.compile(r"[\w\s.,;:!?'’\"“”«»„‘()…。，！？、；：《》（）¿¡\u0300-\u036f-]+")
ASCII_DIGITS, ASCII_PLAIN = (bytes(c for c in range(128) if p.fullmatch(chr(c))) for p in (DIGIT, SYMBOL))
DAMAGED = re.compile(r"[\x80-\x9f\ufffd]|[ÃÂÐÑÅâ][\x80-\xbfŒœž™€“”‘]")
CODE = re.compile(r"[{}=<>()\[\]|&+/\\_$]")
FIGURES = ("word_count", "mean_word_length", "symbol_ratio", "digit_ratio", "end_mark_share", "common_word_share", "running_share", "mean_line_length", "distinct_share", "links_per_word", "length_gap")
#: A page is flagged when its share of running words lies ``TAIL`` robust deviations under its language's median, and
#: ``OTHERS`` other figures ``OTHER_TAIL`` deviations on the side where prose is rare.
TAIL, OTHER_TAIL, OTHERS = 3.0, 0.75, 2
LOW = ("end_mark_share", "common_word_share", "mean_line_length", "distinct_share")
HIGH = ("symbol_ratio", "digit_ratio", "mean_word_length", "links_per_word")
#: The smallest spread of a figure: of shares of a few per cent, and of the others.
FINE = ("symbol_ratio", "links_per_word")
LEAST_SPREAD, LEAST_FINE = 0.02, 0.002


def votes(words: Counter) -> str | None:
    """The language most of the words, with their counts, are common in, if any."""
    found: dict[str, int] = {}
    for w in words.keys() & WORD_LANG.keys():
        for lang in WORD_LANG[w]:
            found[lang] = found.get(lang, 0) + words[w]
    return min(found, key=lambda k: (-found[k], k)) if found else None


def _digits_and_symbols(text: str) -> tuple[int, int]:
    """The number of digits of a text, and that of its symbols."""
    if text.isascii():
        plain = text.encode()
        return len(plain) - len(plain.translate(None, ASCII_DIGITS)), len(plain.translate(None, ASCII_PLAIN))
    return len(DIGIT.findall(text)), len(SYMBOL.sub("", text))


def ended(text: str) -> bool:
    """Whether a text ends as a sentence does, closing quotes and brackets aside."""
    return text.rstrip(CLOSERS)[-1:] in ENDS


def unmarked(line: str) -> str:
    """A line without the mark of an entry that it begins with."""
    m = MARK.match(line)
    return line[m.end() :] if m else line


def mostly_han(text: str) -> bool:
    """Whether more than a fifth of a text are Han characters."""
    return not text.isascii() and 5 * len(HAN.findall(text)) > len(text.strip())


def language(text: str, words: Counter) -> str:
    """The language by script and common words, over all of the text: one of six, or ``xx``."""
    if mostly_han(text):
        return "zh"
    return votes(words) or ("ru" if CYRILLIC.search(text) else "xx")


def words_in(text: str) -> tuple[list[str], int]:
    """The words of a text in small letters without its Han characters, and the number of words with each of those as one."""
    if text.isascii():
        words = (ASCII_WORD if "'" in text else ASCII_RUN).findall(text)
        return words, len(words)
    if not (han := len(HAN.findall(text))):
        words = WORD.findall(text)
        return words, len(words)
    words = WORD.findall(HAN.sub(" ", text))
    return words, len(words) + han


def cells(line: str) -> int:
    """The number of cells of a line that is a row of them, else 0."""
    for sep in SPLITS:
        if sep not in line:
            continue
        parts = [p.strip() for p in line.strip().strip("|").split(sep)]
        if len(parts) >= 2 and sum(bool(CELL.fullmatch(p)) for p in parts) >= 0.7 * len(parts):
            if sep == "  " or len(parts) >= 3 or sep in ("\t", "|", ";", "   ") or any(c.isdigit() for c in line):
                return len(parts)
    return 0


def _runs(unit: str, words: list[str], common: frozenset[str], han: bool) -> bool:
    """Whether a unit of text that ends as a sentence has the words of one."""
    if han:
        return len(HAN.findall(unit)) >= 6
    if len(words) < 4 or sum(map(common.__contains__, words)) < max(1, 0.06 * len(words)):
        return False
    return unit.isascii() or len(DAMAGED.findall(unit)) < 3


def running(unit: str, common: frozenset[str], han: bool) -> int:
    """The number of words of a unit that is a running sentence, else 0: it ends as one and has common words.

    A unit in another language than the page's is judged by its own.
    """
    if not ended(unit) or len(unit) < 60 and MARK.match(unit):
        return 0
    words, count = words_in(unit.lower())
    if not _runs(unit, words, common, han) and not _runs(unit, words, ALL.get(votes(Counter(words)), common), mostly_han(unit)):
        return 0
    return 0 if cells(unit) else count


def entries_apart(lines: list[str]) -> list[str]:
    """Lines in which many marked or closed entries follow one another, with an entry a line."""
    out = []
    text = "\n".join(lines)
    hints = [x for x in INLINE_HINTS if x in text]
    closed = sum(map(text.count, CLOSED_HINTS)) >= 3
    for line in lines:
        if (line[:1].isdigit() or any(x in line for x in hints)) and len(INLINE_MARK.findall(line)) >= 4:
            parts = INLINE_MARK.sub("\n", line).split("\n")
        elif closed and sum(map(line.count, CLOSED_HINTS)) >= 3:
            parts = CLOSED.sub("\n", line).split("\n")
        else:
            parts = [line]
        out += [p for p in (x.strip() for x in parts) if p]
    return out


def figures(lines: list[str], title: str | None, text_length: int | None, links_count: int | None, stored: int) -> dict:
    """The figures of a page's main body and the kind its non-running part looks like."""
    text = "\n".join(lines)
    body = without_headline(lines, title)
    plain = text.lower()
    words, total = words_in(plain)
    counts = Counter(words)
    lang = language(text, counts)
    han = lang == "zh"
    common = ALL.get(lang, ANY)
    body = [unmarked(x) for x in entries_apart(body)]
    joined = unwrapped(body)
    whole = {x for x in joined if len(x) < 80 and not cells(x)}
    bare = sorted(len(unmarked(x)) * (3.5 if han else 1.0) for x in whole)
    entries = len(bare) >= 5 and bare[len(bare) // 2] < ENTRY_LENGTH  # short lines, and not sentences by their length
    run = 0
    rest: list[str] = []
    for unit in sentences(joined):
        if not (entries and unit in whole) and (count := running(unit, common, han)):
            run += count
        else:
            rest.append(unit)
    letters = max(1, len(text) - text.count(" "))
    digits, symbols = _digits_and_symbols(text)
    out = {
        "lang": lang,
        "word_count": float(total),
        "mean_word_length": sum(map(len, words)) / max(1, len(words)),
        "symbol_ratio": symbols / letters,
        "digit_ratio": digits / letters,
        "end_mark_share": sum(map(ended, lines)) / max(1, len(lines)),
        "common_word_share": sum(counts[w] for w in counts.keys() & common) / max(1, len(words)),
        "running_share": run / total if total else 0.0,
        "mean_line_length": len(text) / max(1, len(lines)),
        "distinct_share": len(counts) / max(1, len(words)),
        "links_per_word": (links_count or 0) / max(1, total),
        "length_gap": abs((text_length if text_length is not None else stored) - stored) / max(1, stored),
    }
    out["kind"] = shape(rest, body) if lines and out["running_share"] < 0.5 else None
    return out


def shape(rest: list[str], body: list[str]) -> str:
    """``table``, ``list`` or ``junk`` for text that doesn't run."""
    kept = set(rest)
    lines = [x for x in body if x in kept] or rest
    text = "\n".join(MARK.sub("", x).rstrip(";,. ") for x in rest)
    size = max(1, len(text) - text.count(" "))
    tokens = text.split()
    if len(DAMAGED.findall(text)) > 0.03 * size:
        return "junk"
    rows = sum(len(x) for x in lines if cells(x))
    if rows > 0.5 * sum(map(len, lines)):
        return "table"
    numeric = sum(1 for t in tokens if NUMBER.fullmatch(t) and not NUMBERED.fullmatch(t))
    if numeric >= 0.35 * len(tokens) and len(tokens) > 6 and len(SYMBOL.sub("", text)) < 0.25 * size:
        return "table"
    letters = sum(map(len, LETTERS.findall(text)))
    if letters < 0.5 * size or len(CODE.findall(text)) > 0.06 * size:
        return "junk"
    words = [w for w in WORD.findall(text)]
    han = HAN.search(text)
    if not han and words:
        low = [w.lower() for w in words]
        vowels = sum(1 for w in low if VOWEL.search(w))
        long = sum(1 for w in low if len(w) > 22)
        capital = sum(1 for w in words if w[0].isupper())
        entries = sum(1 for x in lines if x[:1].isupper() or MARK.match(x) or x[:1].isdigit() or x[:1] in "¿¡«“")
        noisy = sum(1 for w in words if not (w.isalpha() and w[1:].islower()) and NOISY.search(w))
        mostly = Counter(low)
        repeated = 1 - len(mostly) / len(low)
        if vowels < 0.75 * len(low) or long > 0.1 * len(low) or noisy > 0.15 * len(low):
            return "junk"
        if capital < 0.04 * len(low) and len(low) > 12:
            return "junk"
        if repeated > 0.55 and entries < 0.3 * len(lines):
            return "junk"
    return "list"


SCHEMA = f"key {{}}, lang string, kind string, residue boolean, {', '.join(f'{f} double' for f in FIGURES)}"


def statistics(df: DataFrame, key: str, text: str, title: str, text_length: str, links_count: str, model: Residue | None = None, status: str | None = None) -> DataFrame:
    """One row of figures per row with text: key, lang, kind, residue and ``FIGURES``.

    ``kind`` is the shape of the non-running part where less than half the words run, else null; ``residue`` tells, of
    those rows alone, that the page is template residue, filler or an error page by ``model``. Null, empty and blank texts give no row; null
    counts are taken as agreeing. Repeated rows repeat; other columns are not read. Without a model, main bodies are
    stored and the models fitted on all of them.
    """
    more = {"n": F.col(text_length).cast("int"), "k": F.col(links_count).cast("int"), "stored": F.length(F.col(text).cast("string"))}
    main = bodies(df, key, text, title, status, more)
    if model is None:
        main = checkpoint(main)
        model = fitted(main, None if status is None else main.where("failed"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                index, rows = [], []
                for i, (h, n, k, stored, lines) in enumerate(zip(*(part.column(c).to_pylist() for c in range(1, 6)))):
                    row = figures(lines, h, n, k, stored)
                    rows.append(row | {"residue": any(shared.value.kinds(lines, h)) if row["kind"] else None})
                    index.append(i)
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in (("lang", pa.string()), ("kind", pa.string()), ("residue", pa.bool_()), *((f, pa.float64()) for f in FIGURES))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index, pa.int64())), *columns], names=["key", "lang", "kind", "residue", *FIGURES])

    plain = main.select("key", "title", "n", "k", "stored", "lines")
    return plain.mapInArrow(run, SCHEMA.format(df.schema[key].dataType.simpleString())).withColumnRenamed("key", key)


def sketches(figured: DataFrame) -> DataFrame:
    """Per language, a KLL sketch of every figure: partial sketches per task, merged by one small shuffle."""
    return figured.groupBy("lang").agg(*(F.kll_sketch_agg_double(f).alias(f) for f in FIGURES))


def references(sketched: DataFrame) -> DataFrame:
    """The sketches each language is judged by: its own, or the merger of all where its median page doesn't run or it is ``xx``."""
    merged = [F.kll_merge_agg_double(f).alias(f"all_{f}") for f in FIGURES]
    rows = sketched.agg(F.collect_list(F.struct("lang", *FIGURES)).alias("rows"), *merged)  # a row a language: a handful
    each = rows.select(F.explode("rows").alias("r"), *(f"all_{f}" for f in FIGURES)).select("r.*", *(f"all_{f}" for f in FIGURES))
    alone = (F.col("lang") != "xx") & (F.kll_sketch_get_quantile_double("running_share", F.lit(0.5)) >= 0.5)
    return each.select("lang", *(F.when(alone, F.col(f)).otherwise(F.col(f"all_{f}")).alias(f) for f in FIGURES))


def scored(figured: DataFrame, sketched: DataFrame | None = None) -> DataFrame:
    """The figures with, for each, its percentile (``_pct``) and robust z-score (``_z``) within its language.

    The percentile is the number of whole per cents of its language whose quantile is smaller. Sketches are a row per
    language, a handful, so they are broadcast. The spread is the smaller of the ranges from the median to the
    quartiles, scaled to a normal deviation, since lists and tables widen one side alone, and at least a small bound so
    that figures all alike divide by no zero. ``reference_runs`` tells whether the median page of the sketches runs.
    """
    sketched = references(sketches(figured) if sketched is None else sketched)
    quantile = lambda f, p: F.kll_sketch_get_quantile_double(F.col(f), F.lit(p))
    ranks = F.array(*(F.lit(k / 100) for k in range(101)))

    def spread(f: str) -> Column:
        middle = quantile(f, 0.5)
        least = F.lit(LEAST_FINE if f in FINE else LEAST_SPREAD)
        return F.greatest(F.least(quantile(f, 0.75) - middle, middle - quantile(f, 0.25)) * (2 / 1.349), least).alias(f"{f}_spread")

    runs = (quantile("running_share", 0.5) >= 0.5).alias("reference_runs")
    levels = sketched.select("lang", runs, *(F.kll_sketch_get_quantile_double(F.col(f), ranks).alias(f"{f}_levels") for f in FIGURES), *(quantile(f, 0.5).alias(f"{f}_mid") for f in FIGURES), *map(spread, FIGURES))
    joined = figured.join(F.broadcast(levels), "lang")

    def z(f: str) -> Column:
        return (F.col(f) - F.col(f"{f}_mid")) / F.col(f"{f}_spread")

    def percentile(f: str) -> Column:
        return F.size(F.filter(f"{f}_levels", lambda q: q < F.col(f))).cast("double").alias(f"{f}_pct")

    return joined.select(*figured.columns, "reference_runs", *(z(f).alias(f"{f}_z") for f in FIGURES), *(percentile(f) for f in FIGURES))


def flagged() -> Column:
    """Whether a scored row lies in the tails: that of the running share, and those of several other figures.

    Where even the corpus as a whole doesn't run at its median, prose is the exception and no tail tells anything: then
    every row is a candidate.
    """
    others = sum([(F.col(f"{f}_z") <= -OTHER_TAIL).cast("int") for f in LOW] + [(F.col(f"{f}_z") >= OTHER_TAIL).cast("int") for f in HIGH], F.lit(0))
    return ~F.col("reference_runs") | (F.col("running_share_z") <= -TAIL) & (others >= OTHERS)


def tails(df: DataFrame, key: str, text: str, title: str, text_length: str, links_count: str, status: str | None = None) -> DataFrame:
    """Key and kind of the rows that are no running prose.

    Rows flagged in the tails of their language's sketches are candidates; of these, rows in which less than half of the
    words run, and which are no residue, are kept. An empty table gives an empty result.
    """
    figured = checkpoint(statistics(df, key, text, title, text_length, links_count, status=status))
    return scored(figured).where(flagged() & (F.col("running_share") < 0.5) & ~F.col("residue") & F.col("kind").isNotNull()).select(key, "kind")
