"""Benchmark passages found in documents by their templates.

A text becomes a row of template tokens: numbers, names and units give way to typed slots, other words are
lower-cased. A run of title-case words is one name. Whether one that begins a sentence is a name cannot be told, so
both readings are taken; function words that begin a sentence are no names. Windows of ``WINDOW`` tokens of
documents are hash-joined with those of the benchmark, so a question with other
numbers or names still meets its template; windows of plain lower-cased words are joined too. Where slots are so dense that
a window holds less than ``LEAST_LITERAL`` plain words, it goes from one plain word to the fourth after it, however far. A
pair counts if enough of the item's windows are found and their slots are filled alike: each of the
item's fillers stands for one filler of the document, and a name of the document for one name of the item; numbers
may meet in one number. Windows with another filler than most are left out. This is judged for each passage of a
document, windows that lie as far apart as in the item up to ``SHIFT`` words, and for the whole document; one has to do.

Before the join, documents' windows pass a bit table of the benchmark's window hashes. Its size is fixed
(``FILTER_BITS``), so what is sent to the tasks is bounded; a crowded table lets more windows through to the join
and loses none.

Defined results: null or empty texts on either side match nothing; an item shorter than a window
has one window of its whole length; items with less than ``LEAST_LITERAL`` plain words (short items: that
share) cannot be told from their slots and match by plain words only; equal items are all reported; rows
with null ids are not reported, but ``clean_documents`` heeds items without an id; repeated rows give one
pair; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroflow.llm.common import Bounded, claim, write_and_read
from hydroflow.llm.tokens import in_slices

WINDOW = 8
#: Plain words that a window with slots needs; with less, windows get longer.
LEAST_LITERAL = 5
#: A pair counts with this share of the item's windows, or with this many windows.
LEAST_SHARE, LEAST_WINDOWS = 0.5, 8
#: Words that may be put in or left out between windows of one passage.
SHIFT = 4
FILTER_BITS = 1 << 23
#: Characters of texts that are read together, about; a longer text is read alone.
SLICE_CHARS = 500_000
EDGE = ".,;:!?\"'()[]{}<>*#$%&|~_-=+…“”„»«¡¿"
NUMBER = re.compile(r"[+-]?(\d+([.,/:]\d+)*|\d*\.\d+)(st|nd|rd|th)?")
WITH_UNIT = re.compile(r"([+-]?\d[\d.,]*)([a-zA-Zµ°%]+[23]?)")
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand "
                         "million dozen half".split())
UNITS = frozenset("mm cm m km in ft mi inch inches foot feet mile miles meter meters metre metres kilometer kilometers kilometre "
                  "kilometres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres "
                  "gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month "
                  "months year years km/h mph m/s °c °f % percent usd eur dollar dollars euro euros cent cents".split())
#: Words that are no names where they begin a sentence.
STARTERS = frozenset("a an the this that these those he she it we you they i his her its our your their my there here what which who whom whose "
                     "when where why how if in on at by for from with without to of as and or but so yet not no after before during while "
                     "then than once since until because although though each every all some any both many much more most few several "
                     "is are was were be do does did has have had can could will would shall should may might must let given suppose find "
                     "der die das den dem des ein eine einen einem einer er sie es wir ihr ich sein seine ihre was wer wie wo wann warum wenn "
                     "im am auf aus bei mit nach von vor zu für und oder aber nicht kein keine ist sind war hat haben wird werden welche "
                     "welcher welches jeder jede alle dann nun als dass ob "
                     "le la les l un une des du de il elle ils elles on nous vous je tu ce cette ces son sa ses leur que qui quoi quand où "
                     "comment pourquoi combien si dans en sur par pour avec sans et ou mais est sont a ont chaque quel quelle quels quelles "
                     "el los las una unos unas del al ella ellos ellas nosotros yo su sus este esta estos estas qué quién cuándo dónde cómo "
                     "cuánto cuántos cuántas cuál por para con sin y o pero no es son hay cada cuando donde como porque".split())
#: Slots by type; a title-case word that begins a sentence is MAYBE a name.
LITERAL, OF_NUM, OF_UNIT, OF_NAME, MAYBE = range(5)
#: Added to the type of a name that goes on with the word before it.
GOES_ON = 8
NUM, UNIT, NAME = "\x01num", "\x01unit", "\x01name"
SLOTS = ("", NUM, UNIT, NAME)
SENTENCE_END = (".", "!", "?", ":")


def _number(low: str) -> bool:
    return low in NUMBER_WORDS or not low.isalpha() and (
        bool(NUMBER.fullmatch(low)) or "-" in low and all(p in NUMBER_WORDS or NUMBER.fullmatch(p) for p in low.split("-")))


#: What a word as it stands in a text is; BOTH is a number with its unit, NONE has no letters or digits.
WORD, IS_NUM, IS_UNIT, TITLE, STARTER, BOTH, NONE = range(7)
#: Added to that: the word ends a sentence, a sign follows it.
ENDS, CLOSED = 8, 16


class _Words(Bounded):
    """A number for each word as it stands in a text; by number: the plain word, its hash and what it is.

    Words met when the table is full are let go at the next call.
    """

    ENTRY = 220

    def __init__(self, most_bytes: int = 96_000_000):
        super().__init__(most_bytes)
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.plain, self.units, self._over, self._kept = [], {}, [], 0
        self.hashes, self.marks, self._new = np.zeros(0, np.uint64), np.zeros(0, np.uint8), ([], [])

    def _add(self, word: str, mark: int) -> int:
        self.plain.append(word)
        self._new[0].append(xxhash.xxh3_64_intdigest(word))
        self._new[1].append(mark)
        return len(self.plain) - 1

    def __missing__(self, raw: str) -> int:
        word, mark, unit = raw.strip(EDGE), 0, ""
        if word is not raw:
            mark = ENDS * raw.endswith(SENTENCE_END) + CLOSED * (raw[-1] in EDGE)
        low = word.lower()
        if word.isalpha():
            both, front, back = None, "", ""
        else:
            both = WITH_UNIT.fullmatch(word)
            front, _, back = low.rpartition("-")
        if not word:
            kind = NONE
        elif both and both[2].lower() in UNITS:
            low, kind, unit = both[1], BOTH, both[2].lower()
        elif back in UNITS and _number(front):
            low, kind, unit = front, BOTH, back
        elif _number(low):
            kind = IS_NUM
        elif low in UNITS:
            kind = IS_UNIT
        elif len(word) > 1 and word[0].isupper() and word[1:].islower():
            kind = STARTER if low in STARTERS else TITLE
        else:
            kind = WORD
        self[raw] = n = self._add(low, kind + mark)
        if unit:
            self.units[n] = self._add(unit, IS_UNIT)
        if self.held < self.most_bytes:
            self.held += len(raw) + self.ENTRY
            self._kept = len(self.plain)
        else:
            self._over.append(raw)
        return n

    def numbers(self, raws: list[str]) -> np.ndarray:
        """The numbers of words, good until the next call."""
        claim(self)
        for raw in self._over:
            del self[raw]
        self._over, kept = [], self._kept
        del self.plain[kept:]
        found = np.fromiter(map(self.__getitem__, raws), np.int64, len(raws))
        self.hashes = np.concatenate([self.hashes[:kept], np.array(self._new[0], np.uint64)])
        self.marks = np.concatenate([self.marks[:kept], np.array(self._new[1], np.uint8)])
        self._new = [], []
        return found


_SEEN = _Words()


class Template(NamedTuple):
    """The words of some texts, one text after the other."""

    edges: np.ndarray  # where each text begins, and the end
    plain: list[str]  # lower-cased words by number
    numbers: np.ndarray
    hashes: np.ndarray
    types: np.ndarray


def template(texts: list[str | None]) -> Template:
    """Plain words of texts, their 64-bit hashes and types.

    A name is a word in title case, for certain if it does not begin a sentence or line; a unit follows a number.
    """
    raws, lines, text_ends = [], [], []
    for text in texts:
        for line in (text or "").split("\n"):
            lines.append(len(raws))
            raws += line.split()
        text_ends.append(len(raws))
    numbers, n = _SEEN.numbers(raws), len(raws)
    marks = _SEEN.marks[numbers]
    kind, ends, closed, at = marks & 7, marks & ENDS > 0, marks & CLOSED > 0, np.arange(n)
    # A word begins a sentence if no word of its line is before it, or if the last sign or word that tells ends one.
    begins = np.zeros(n + 1, bool)
    begins[lines] = True
    begins = begins[:n]
    tells = np.concatenate([[-1], np.maximum.accumulate(np.where((kind != NONE) | ends, at, -1))])[:n]
    start = (tells < np.maximum.accumulate(np.where(begins, at, 0))) | ends[tells] if n else ends
    types = np.zeros(n, np.uint8)
    types[(kind == IS_NUM) | (kind == BOTH)] = OF_NUM
    title = kind == TITLE
    name = title | (kind == STARTER) & ~start
    types[name] = OF_NAME
    types[title & start] = MAYBE
    types[1:][name[1:] & name[:-1] & ~closed[:-1] & ~begins[1:]] += GOES_ON
    # Words without letters or digits go; a number with its unit becomes two words.
    times = (kind != NONE) + (kind == BOTH).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], text_ends]).astype(np.int64)]
    numbers, types, kind = np.repeat(numbers, times), np.repeat(types, times), np.repeat(kind, times)
    second = np.cumsum(times)[times == 2] - 1
    types[second] = OF_UNIT
    numbers[second] = [_SEEN.units[k] for k in numbers[second].tolist()]
    follows = np.concatenate([[False], types[:-1] == OF_NUM])[:len(types)]
    follows[edges[edges < len(types)]] = False
    types[follows & (kind == IS_UNIT)] = OF_UNIT
    return Template(edges, _SEEN.plain, numbers, _SEEN.hashes[numbers], types)


#: Powers of an odd number and of its inverse modulo 2 ** 64, as many as the longest text so far needs.
BASE, SIZE_FACTOR = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            factors = np.full(2 * n, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.cumprod(factors)
    return _POWERS


class _Windows:
    """Hashes of any runs of tokens, from sums over their beginnings."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = _powers(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[:len(hashes)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * SIZE_FACTOR

    def all(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        out = self.sums[size:] - self.sums[:n]
        out *= self.down[:n]
        out += np.uint64(int(SIZE_FACTOR) * size % (1 << 64))
        return out


class Found(NamedTuple):
    """Windows of texts that may be matched, all of one reading."""

    hashes: np.ndarray
    starts: np.ndarray  # words
    ends: np.ndarray
    sizes: np.ndarray  # tokens; 0 for windows as long as their slots ask
    slots: np.ndarray | None  # types of the texts' words in this reading; None: plain words


_SLOT_HASHES = np.array([xxhash.xxh3_64_intdigest(s) for s in SLOTS], np.uint64)


class Reading(NamedTuple):
    words: Template
    text: np.ndarray  # which text each word is of
    places: np.ndarray  # place of each word in its text when runs of names are one
    found: list[Found]

    def fillers(self, slots: np.ndarray | None, a: int, b: int) -> list[str]:
        """What stands in the slots of a window, with its type."""
        out = []
        if slots is not None:
            for k in range(a, b):
                word = self.words.plain[self.words.numbers[k]]
                if k > a and self.places[k] == self.places[k - 1] and slots[k] == slots[k - 1] == OF_NAME:
                    out[-1] += " " + word
                elif slots[k]:
                    out.append(SLOTS[slots[k]] + " " + word)
        return out


def _read(texts: list[str | None], sizes: list[int] | None) -> Reading:
    """The windows of texts, none across two of them; no sizes: ``WINDOW``, or the whole of one shorter text."""
    words = template(texts)
    plain, types, n = words.hashes, words.types, len(words.types)
    text = np.repeat(np.arange(len(texts)), np.diff(words.edges))
    hasher, found = _Windows(plain), []
    for size in sizes or [min(n, WINDOW)]:
        at = np.arange(max(0, n - size + 1) if size else 0)
        inside = text[at] == text[at + size - 1]
        at = at[inside]
        found.append(Found(hasher.all(size)[:len(inside)][inside], at, at + size, np.full(len(at), size), None))
    if not types.any():
        return Reading(words, text, np.arange(n) - words.edges[text], found)
    goes_on, types = types >= GOES_ON, types & (GOES_ON - 1)
    maybe, places = types == MAYBE, None
    for with_maybe in (True, False) if maybe.any() else (True,):
        slots = np.where(maybe, OF_NAME if with_maybe else LITERAL, types)
        names = slots == OF_NAME
        kept = np.ones(n, bool)
        kept[1:] = ~(goes_on[1:] & names[1:] & names[:-1])
        if places is None:
            places = np.cumsum(kept)
            places -= places[words.edges[text]]
        first = np.flatnonzero(kept)
        m, edge, is_literal, of = len(first), np.append(first, n), slots[first] == LITERAL, text[first]
        hasher = _Windows(np.where(is_literal, plain[first], _SLOT_HASHES[slots[first]]))
        literal = np.concatenate([[0], np.cumsum(is_literal)])
        spans = []
        for size in sizes or [min(m, WINDOW)]:
            n_literal = literal[size:] - literal[:-size]
            at = np.flatnonzero((n_literal < size) & (n_literal * WINDOW >= LEAST_LITERAL * size))
            spans.append((at, at + size, np.full(len(at), size)))
        at = np.flatnonzero(is_literal)
        a, b = at[:-(LEAST_LITERAL - 1)], at[LEAST_LITERAL - 1:] + 1
        far = b - a > WINDOW
        spans.append((a[far], b[far], np.zeros(far.sum(), int)))
        a, b, size = (np.concatenate(x) for x in zip(*spans))
        wanted = of[a] == of[b - 1]
        if not with_maybe:  # windows without such words are those of the other reading
            so_far = np.concatenate([[0], np.cumsum(maybe[first])])
            wanted &= so_far[b] > so_far[a]
        a, b, size = a[wanted], b[wanted], size[wanted]
        if len(a):
            found.append(Found(hasher.of(a, b), edge[a], edge[b], size, slots))
    return Reading(words, text, places, found)


def benchmark_windows(items: DataFrame) -> DataFrame:
    """hash, item_id, place, fillers, first and last of the plain windows that it covers and number of windows of every item."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                read = _read([text], None)
                n = len(read.text)
                least = min(n, WINDOW)
                for x in read.found:
                    rows += [(int(h.astype(np.int64)), item, int(read.places[a]), int(a), int(max(a, b - least)), read.fillers(x.slots, a, b),
                              int(size), n - least + 1) for h, a, b, size in zip(x.hashes, x.starts, x.ends, x.sizes)]
            yield pd.DataFrame(rows, columns=["hash", "item_id", "item_at", "low", "high", "item_fillers", "size", "n_windows"])

    return items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInPandas(
        run, "hash long, item_id long, item_at int, low int, high int, item_fillers array<string>, size int, n_windows int")


def bit_table(known: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set at the hashes; distinct bytes are summed up by Spark, at most FILTER_BITS / 8 rows."""
    bits = known.select(F.col("hash").bitwiseAND(FILTER_BITS - 1).alias("b")).distinct()
    parts = bits.groupBy(F.expr("b div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(b % 8 as int)))").alias("v")).toPandas()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    table[parts["byte"].to_numpy(np.int64)] = parts["v"].to_numpy(np.uint8)
    return table


def document_windows(docs: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """Windows of all documents that pass the bit table: hash, doc_id, position, fillers."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = sent.value
        for batch in batches:
            rows, docs, texts = [], batch["doc_id"].tolist(), [t or "" for t in batch["text"]]
            for i, j in in_slices(texts, SLICE_CHARS):
                read = _read(texts[i:j], sizes)
                for x in read.found:
                    b = (x.hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    hits = np.flatnonzero(bits[b >> 3] >> (b & 7).astype(np.uint8) & 1)
                    at, end = x.starts[hits], x.ends[hits]
                    rows += [(h, docs[i + t], place, read.fillers(x.slots, a, e)) for h, t, place, a, e in zip(
                        x.hashes[hits].astype(np.int64).tolist(), read.text[at].tolist(), read.places[at].tolist(), at.tolist(), end.tolist())]
            yield pd.DataFrame(rows, columns=["hash", "doc_id", "doc_at", "fillers"])

    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "hash long, doc_id long, doc_at int, fillers array<string>")


def passages(rows: DataFrame) -> DataFrame:
    """doc_id, item_id, shift and the first and last shift of every passage that the shift is in.

    A passage is where windows lie about as far apart as in the item: all shifts of a pair that are up to ``SHIFT`` from some
    number, or all of its shifts. Numbers that hold the same shifts are one passage, so windows that lie as in the item are judged once.
    """
    pair = ["doc_id", "item_id"]
    shifts = rows.select(*pair, "shift").distinct()
    about = shifts.withColumn("about", F.explode(F.sequence(F.col("shift") - SHIFT, F.col("shift") + SHIFT)))
    near = about.groupBy(*pair, "about").agg(F.sort_array(F.collect_list("shift")).alias("held")).select(*pair, "held").distinct()
    near = near.select(*pair, F.explode("held").alias("shift"), F.array_min("held").alias("first"), F.array_max("held").alias("last"))
    whole = shifts.groupBy(*pair).agg(F.min("shift").alias("first"), F.max("shift").alias("last")).filter(F.col("last") - F.col("first") > 2 * SHIFT)
    return near.unionByName(shifts.join(whole, pair))


def _covered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The item's windows that rows cover, by keys: 64 of them are the bits of one number."""
    rows = rows.withColumn("window", F.explode(F.sequence("low", "high")))
    return rows.groupBy(*keys, F.expr("window div 64").alias("part")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(window % 64 as int))")).alias("bits"), F.max("n_windows").alias("n_windows"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, windows found and the item's windows, for every document that holds a benchmark item.

    A passage that many documents hold is one row per document and window of the item; the pair is
    summed up by an aggregate on both ids, so neither a popular item nor a long document is one group.
    """
    known = benchmark_windows(items)
    sizes = sorted(r["size"] for r in known.filter("size > 0").select("size").distinct().collect())
    found = document_windows(docs, bit_table(known), sizes).join(known, "hash").filter(F.size("fillers") == F.size("item_fillers"))
    pairs = F.arrays_zip(F.col("item_fillers").alias("i"), F.col("fillers").alias("d"))
    # written once, so that texts are not gone through again when a shuffle is planned
    rows = write_and_read(found.select("hash", "doc_id", "item_id", "doc_at", "item_at", (F.col("doc_at") - F.col("item_at")).alias("shift"),
                                       "low", "high", "n_windows", pairs.alias("pairs")), "template-matches")
    places, here = passages(rows), ["doc_id", "item_id", "first", "last"]
    # Windows without slots have nothing to judge: what they cover is summed up before they go to their passages.
    plain = _covered(rows.filter(F.size("pairs") == 0), ["doc_id", "item_id", "shift"]).join(places, ["doc_id", "item_id", "shift"]).drop("shift")
    spread = rows.filter(F.size("pairs") > 0).join(places, ["doc_id", "item_id", "shift"]).withColumn("p", F.explode("pairs")).select(
        "hash", *here, "doc_at", "item_at", "low", "high", "n_windows", F.col("p.i").alias("i"), F.col("p.d").alias("d"))
    spread = spread.withColumn("n", F.count("*").over(Window.partitionBy(*here, "i", "d")))
    # A filler of the item stands for the one that most of a passage's windows have, and a name of the document for one name.
    forth = F.max(F.struct("n", "d")).over(Window.partitionBy(*here, "i"))["d"]
    back = F.max(F.struct("n", "i")).over(Window.partitionBy(*here, "d"))["i"]
    spread = spread.withColumn("forth", forth).withColumn("back", back)
    alike = (F.col("d") == F.col("forth")) & ((F.col("i") == F.col("back")) | ~F.col("i").startswith(NAME))
    met = spread.withColumn("alike", alike).groupBy(*here, "doc_at", "item_at", "hash", "low", "high").agg(
        F.min("alike").alias("alike"), F.max("n_windows").alias("n_windows")).filter("alike")
    counts = plain.unionByName(_covered(met, here)).groupBy(*here, "part").agg(F.bit_or("bits").alias("bits"), F.max("n_windows").alias("n_windows"))
    counts = counts.groupBy(*here).agg(F.sum(F.bit_count("bits")).alias("found"), F.max("n_windows").alias("n_windows"))
    counts = counts.groupBy("doc_id", "item_id").agg(F.max("found").alias("found"), F.max("n_windows").alias("n_windows"))
    enough = (F.col("found") >= LEAST_WINDOWS) | (F.col("found") >= LEAST_SHARE * F.col("n_windows"))
    return counts.filter(enough).select("doc_id", "item_id", F.col("found").cast("long").alias("windows_found"), F.col("n_windows").cast("long").alias("n_windows"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark item, be its id null or not."""
    items = items.select(F.xxhash64("item_id", "text").alias("item_id"), "text").distinct()
    bad = contaminated(docs, items).select(F.col("doc_id").alias("_bad_id")).distinct()
    return docs.join(bad.hint("merge"), docs["doc_id"] == bad["_bad_id"], "left_anti")
