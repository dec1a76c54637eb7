"""Toxic clauses found by a weighted finite-state grammar.

Words are mapped to symbols: insult (learned from labels, with a weight), threat, target, negation, reported speech.
Three small transducers read the symbols of a clause: one remembers that a target was named, one
that a negation stands shortly before, one that the clause reports what somebody said. The first also reads the
clause from its end, for targets named after the word. Their
composition, a product automaton built once, turns each insult or threat into an output class such as
"insult, at a target" or "threat, negated". A match weighs as its class does in the training
labels, drawn towards a prior, plus what its word adds; a text's score joins its clauses' matches.

Defined results: a null or empty text has no clause and gets the score of texts without a match;
labels that are null or whose document is missing are not used; several labels of a document count as
their mean, ties as 1; without toxic training rows only the priors count; rows with equal or null
ids are kept; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroflow.llm.quality_qda import labels_of

#: Training documents of either label at most: those with the smallest hash of their id.
FIT_ROWS = 20_000
#: Learned entries at most, the heaviest first, and how sure and how heavy an entry must be.
LEXICON_SIZE, LEAST_G2, LEAST_WEIGHT, LEAST_CONTEXTS = 20_000, 16.0, 3.0, 3
PREFIXES = (4, 5, 6)
EDGE = ".,;:!?\"'()[]{}<>*#$%&|~_-=+…“”„»«¡¿"
CLAUSE = re.compile(r"[.!?;\n]+")
CLAUSE_ENDS = ".!?;\n"

TARGET = frozenset("you your yours u he she they him her them his their du dich dir dein deine ihr euch er sie tu te toi ton ta vous "
                   "votre il elle ils elles usted tú ti tus ella ellos vosotros".split())
NEGATION = frozenset("not no never nobody none isn't aren't wasn't don't doesn't didn't won't nicht kein keine keinen nie niemals "
                     "pas jamais aucun aucune nunca jamás ningún ninguna tampoco".split())
REPORT = frozenset("said says say saying told reported reports quoted quote quotes wrote writes according claimed called allegedly "
                   "sagte sagt schrieb laut dit disait selon écrit dijo dice según escribió".split())
THREAT = frozenset("kill kills killed killing murder murders murdered murdering hurt hurts hurting stab stabs stabbed stabbing shoot shoots "
                   "shot shooting strangle strangles strangled strangling beat beats beaten beating "
                   "töten töte tötest tötet tötete töteten getötet umbringen umbringe umbringst umbringt umbrachte umgebracht umzubringen "
                   "schlagen schlage schlägst schlägt schlug schlugen geschlagen "
                   "tuer tue tues tuons tuez tuent tuais tuait tuaient tuerai tueras tuera tuerons tuerez tueront tuerais tuerait tuant tué "
                   "tués tuée tuées frapper frappe frappes frappons frappez frappent frappais frappait frappaient frapperai frapperas "
                   "frappera frapperons frapperez frapperont frapperais frapperait frappant frappé frappés frappée frappées "
                   "matar mato matas mata matamos matan maté mataste mató mataron mataré matarás matará mataremos matarán mataría mate "
                   "mates maten matado matando golpear golpeo golpeas golpea golpeamos golpean golpeé golpeaste golpeó golpearon golpearé "
                   "golpearás golpeará golpearemos golpearán golpearía golpee golpees golpeen golpeado golpeando".split())
#: Spanish threats that end in their target.
AIMED = frozenset(stem + who for stem in ("matar", "matándo", "golpear", "golpeándo") for who in "te lo la le los las les os".split())
#: Steps for which a transducer remembers.
NEAR_NEGATION, NEAR_TARGET = 3, 4


def _negation(state: int, symbol: str) -> int:
    return NEAR_NEGATION if symbol == "neg" else max(0, state - 1)


def _report(state: int, symbol: str) -> int:
    return 1 if symbol == "report" else state


def _target(state: int, symbol: str) -> int:
    return NEAR_TARGET if symbol == "target" else max(0, state - 1)


SYMBOLS = ("word", "insult", "threat", "aimed", "target", "neg", "report")
#: Symbols that may be turned into an output class.
TOXIC = ("insult", "threat", "aimed")


def compose() -> dict[tuple, tuple]:
    """(state, symbol, target ahead) -> (state, output class or None) of the composed transducer.

    An output class is (kind, at a target, negated, reported); threats need a target, before or after them.
    """
    arcs = {}
    states = itertools.product(range(NEAR_NEGATION + 1), (0, 1), range(NEAR_TARGET + 1))
    for (n, r, t), symbol, ahead in itertools.product(list(states), SYMBOLS, (False, True)):
        at = t > 0 or ahead or symbol == "aimed"
        out = ("insult" if symbol == "insult" else "threat", at, n > 0, r > 0) if symbol == "insult" or symbol in TOXIC and at else None
        arcs[(n, r, t), symbol, ahead] = (_negation(n, symbol), _report(r, symbol), _target(t, symbol)), out
    return arcs


ARCS = compose()
START = (0, 0, 0)
CLASSES = tuple(sorted({out for _, out in ARCS.values() if out}))
#: Log-odds that a class has before any label is seen: plain, and changes for a target, a negation, a report.
PRIOR, AT_TARGET, NEGATED, REPORTED, PRIOR_DOCUMENTS = 2.0, 0.6, -3.2, -2.4, 2.0


def prior(output: tuple) -> float:
    _, target, negated, reported = output
    return PRIOR + AT_TARGET * target + NEGATED * negated + REPORTED * reported


def plain(word: str) -> str:
    return word.strip(EDGE)


def words_of_clauses(low: str) -> list[str]:
    """The words of all clauses as they stand, in order."""
    for c in CLAUSE_ENDS:
        low = low.replace(c, " ")
    return low.split()


def units(word: str) -> list[str]:
    """A word and its beginnings, as lexicon entries."""
    return [word] + [word[:k] + "-" for k in PREFIXES if len(word) > k + 1]


class Grammar:
    """The lexicon's weights and the class log-odds; reads texts."""

    def __init__(self, lexicon: dict[str, float], odds: dict[tuple, float], nothing: float):
        self.lexicon, self.odds, self.nothing = lexicon, odds, nothing
        self._seen: dict[str, tuple[str, float]] = {}

    def symbol(self, raw: str) -> tuple[str, float]:
        """Symbol and weight of a word as it stands in the text, lower-cased."""
        found = self._seen.get(raw)
        if found is None:
            word = plain(raw)
            weight = max((self.lexicon[u] for u in units(word) if u in self.lexicon), default=0.0) if word else 0.0
            kind = ("insult" if weight else "neg" if word in NEGATION else "target" if word in TARGET else
                    "report" if word in REPORT else "threat" if word in THREAT else "aimed" if word in AIMED else "word")
            if len(self._seen) > 500_000:
                self._seen.clear()
            found = self._seen[raw] = kind, weight
        return found

    def matches(self, text: str | None) -> list[tuple[tuple, float, int]]:
        """(output class, weight, clause number) of each insult or threat that the automaton accepts."""
        if not text:
            return []
        low = text.lower()
        if not any(self.symbol(w)[0] in TOXIC for w in set(words_of_clauses(low))):
            return []
        found = []
        for k, clause in enumerate(CLAUSE.split(low)):
            symbols = [self.symbol(w) for w in clause.split()]
            if not any(s in TOXIC for s, _ in symbols):
                continue
            ahead, near = [], 0
            for s, _ in reversed(symbols):
                ahead.append(near > 0)
                near = _target(near, s)
            state = START
            for (s, weight), target in zip(symbols, reversed(ahead)):
                state, out = ARCS[state, s, target]
                if out:
                    found.append((out, weight, k))
        return found

    def score(self, text: str | None) -> float:
        """1 minus the product of what each clause leaves open; a clause counts by its heaviest match."""
        clauses: dict[int, float] = {}
        for out, weight, k in self.matches(text):
            logit = self.odds.get(out, prior(out)) + (0.25 * (min(weight, 8.0) - LEAST_WEIGHT) if weight else 0.0)
            clauses[k] = max(clauses.get(k, -50.0), logit)
        open_share = 1.0 - self.nothing
        for logit in clauses.values():
            open_share *= 1 / (1 + math.exp(min(700, logit)))
        return 1.0 - open_share


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, text, label of at most ``FIT_ROWS`` documents of either label."""
    known = labels_of(labels, "toxic").filter(~held_out).withColumn("at", F.xxhash64("doc_id"))
    parts = [known.filter(F.col("label") == k).orderBy("at").limit(FIT_ROWS) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("known_id"), "label")
    chosen = F.broadcast(chosen)  # at most 2 * FIT_ROWS rows of two numbers
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("known_id")).select("doc_id", "text", "label")


def _count_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and entry: documents of either label and up to some contexts (words before) of all places in the toxic ones."""
    counts: dict[str, list] = {}
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"]):
            before, lefts = "", {}
            for raw in words_of_clauses((text or "").lower()):
                word = plain(raw)
                if word:
                    lefts.setdefault(word, set()).add(before)
                before = word
            met = set()
            for word, left in lefts.items():
                for u in units(word):
                    c = counts.setdefault(u, [0, 0, set()])
                    if u not in met:
                        met.add(u)
                        c[label] += 1
                    if label and len(c[2]) < LEAST_CONTEXTS:
                        c[2].update(zlib.crc32(x.encode()) for x in sorted(left)[:LEAST_CONTEXTS])
        if len(counts) > 1_000_000:
            yield _count_rows(counts)
            counts = {}
    yield _count_rows(counts)


def _count_rows(counts: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame({"unit": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()],
                         "contexts": [sorted(c[2]) for c in counts.values()]})


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entries that toxic training documents hold far more often, in several contexts; at most ``LEXICON_SIZE``."""
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(size) < 2:
        return {}
    n0, n1 = float(size[0]), float(size[1])
    counts = rows.select("text", "label").mapInPandas(_count_units, "unit string, clean long, toxic long, contexts array<long>")
    counts = counts.groupBy("unit").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"),
                                        F.flatten(F.collect_set("contexts")).alias("contexts")).filter("t >= 3")
    counts = counts.withColumn("contexts", F.size(F.array_distinct("contexts")))
    expected = (F.col("c") + F.col("t")) * (n1 / (n0 + n1))
    other = (F.col("c") + F.col("t")) - expected
    g2 = 2 * (F.col("t") * F.log(F.col("t") / expected) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / other)).otherwise(0.0))
    weight = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    kept = counts.withColumn("weight", weight).filter((weight >= LEAST_WEIGHT) & (g2 >= LEAST_G2) & (F.col("contexts") >= LEAST_CONTEXTS))
    return {r["unit"]: r["weight"] for r in kept.orderBy(F.desc("weight"), "unit").limit(LEXICON_SIZE).collect()}


def learn_odds(rows: DataFrame, lexicon: dict[str, float]) -> Grammar:
    """Log-odds of each output class, from the training documents that hold a match of it."""
    names = {c: "|".join(map(str, c)) for c in CLASSES}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(lexicon, {}, 0.0)
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["label"]):
                met = {names[m[0]] for m in grammar.matches(text)}
                out += [(name, label) for name in met or {""}]
            yield pd.DataFrame(out, columns=["output", "label"])

    found = rows.select("text", "label").mapInPandas(run, "output string, label int").groupBy("output", "label").count().collect()
    count = {(r["output"], r["label"]): r["count"] for r in found}
    odds = {}
    for c in CLASSES:
        p = 1 / (1 + math.exp(-prior(c)))
        odds[c] = math.log((count.get((names[c], 1), 0) + PRIOR_DOCUMENTS * p) / (count.get((names[c], 0), 0) + PRIOR_DOCUMENTS * (1 - p)))
    missed, quiet = count.get(("", 1), 0), count.get(("", 0), 0)
    return Grammar(lexicon, odds, min(0.3, (missed + 0.1) / (missed + quiet + 1.0)))


def learn(docs: DataFrame, labels: DataFrame, held_out: Column) -> Grammar:
    """The grammar that the labels teach; labels of held-out documents are not read."""
    rows = training_rows(docs, labels, held_out)
    return learn_odds(rows, learn_lexicon(rows))


def keep(docs: DataFrame, grammar: Grammar, below: float) -> DataFrame:
    """The documents, all columns, with a score below a limit."""
    lexicon, odds, nothing = grammar.lexicon, grammar.odds, grammar.nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(lexicon, odds, nothing)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t) < below for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out and score of every document; labels of held-out ones are not read."""
    model = learn(docs, labels, held_out)
    lexicon, odds, nothing = model.lexicon, model.odds, model.nothing

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(lexicon, odds, nothing)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").values, "held_out": batch["held_out"].values,
                                "score": [grammar.score(t) for t in batch["text"]]})

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out)
    return chosen.mapInPandas(run, "doc_id long, held_out boolean, score double")


def clause_matches(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Every match: doc_id, clause number, kind, flags and the word's weight."""
    lexicon, odds, nothing = grammar.lexicon, grammar.odds, grammar.nothing

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Grammar(lexicon, odds, nothing)
        for batch in batches:
            rows = [(d, k, *out, w) for d, t in zip(batch["doc_id"], batch["text"]) for out, w, k in own.matches(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "clause", "kind", "targeted", "negated", "reported", "weight"])

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, clause int, kind string, targeted boolean, negated boolean, reported boolean, weight double")
