"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into words (runs of letters, lower-cased) and clauses (ended by . ! ? ; : or a line end). Each word belongs to
word classes: insult, threat, target, negation, report, intensifier. Small transducers read the classes of a clause from
left to right; composed, they give each insult or threat its reading:

    reported   a reporting verb or an open quote stands before it
    negated    a negation stands up to three words before it, none in between being an insult or threat
    aimed      a target stands within four words of it
    plain      none of these
    hint       a word with a learned beginning, of which the text holds too few

A clause's readings are the features; a text's are how many clauses hold each, so an isolated word counts for what its
clause makes of it. A logistic model, learned from labelled rows, weighs them.

The insults are a fixed list and stems learned from the labelled rows: word beginnings (4 to 8 letters), with the number of
words of a text that must begin so (one to three), that at least ``least`` toxic texts hold and that are ``odds`` times
likelier in toxic texts, taken one by one for texts that no insult explains so far. Beginnings that the same texts hold are
one candidate. Candidates are weighed in rounds, each over the texts that are still open, until no beginning passes, so a
text whose words fill a round hides no other. Learning reads at most ``sample`` labelled rows (those with the least hashes of
their ids; whole texts), so the driver sees bounded counts whatever the input.

Empty and null texts and texts without any match get the score of no features. A label of a row that is not among the texts,
a null label, and other columns are ignored; of a row's labels the largest counts. Repeated rows are scored alike. Without
both kinds of labels the model is the share of toxic rows (one half if there are none). An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmix.storage import drop_table, stage

# Fixed word lists.
INSULTS = (
    "idiot idiots stupid moron morons loser losers scum trash garbage pathetic worthless disgusting clown clowns dumb fool fools "
    "imbecile pig pigs rat rats vermin filth filthy freak freaks coward liar jerk creep ugly useless hate hated"
).split()
THREATS = "kill hurt beat destroy burn shoot stab crush punish smash strangle attack".split()
TARGETS = "you your yours yourself u he she they them his her their these those people".split()
NEGATIONS = "not no never neither nor cannot without isn't aren't don't doesn't didn't won't".split()
REPORTS = "said says say wrote writes called calls reported reports quoted according claimed claims told".split()
CLASSES = {"insult": INSULTS, "threat": THREATS, "target": TARGETS, "negation": NEGATIONS, "report": REPORTS}
READINGS = ("plain", "aimed", "negated", "reported")
FEATURES = [f"{kind}_{reading}" for kind in ("insult", "threat") for reading in READINGS] + ["hint"]
_STEMS = range(4, 9)
_LEVELS = 3
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]+|[\"“”«»]")


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # labelled rows to learn from, at most
    least: int = 4
    odds: float = 20.0
    candidates: int = 2000  # stems that are weighed against each other in a round
    ridge: float = 0.02


@dataclass(frozen=True)
class Grammar:
    """Word classes: whole words, and stems of insults with the number of words of a text that must begin so."""

    words: dict[str, str]
    stems: dict[str, int]

    def classes(self, words: Sequence[str]) -> list[str]:
        """The class of each word of a text."""
        begun = Counter(w[:n] for w in words for n in _STEMS if len(w) >= n and w[:n] in self.stems) if self.stems else {}
        active = {s for s, n in begun.items() if n >= self.stems[s]}

        def learned(word: str) -> str:
            own = {word[:n] for n in _STEMS}
            return "insult" if own & active else "hint" if own & begun.keys() else ""

        return [self.words.get(w) or (learned(w) if begun else "") for w in words]

    def candidates(self, kinds: Sequence[str] = ("insult", "threat")) -> re.Pattern:
        """Finds texts that hold a word of these classes at all."""
        whole = sorted(w for w, c in self.words.items() if c in kinds)
        parts = [rf"(?:{'|'.join(map(re.escape, whole))})(?![^\W\d_])"] if whole else []
        # A stem whose beginning is a stem adds nothing.
        short = [s for s in sorted(self.stems) if not any(s[:n] in self.stems for n in range(4, len(s)))]
        parts += [rf"(?:{'|'.join(map(re.escape, short))})"] if short else []
        return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(parts)})")


def base_grammar(stems: dict[str, int] | None = None) -> Grammar:
    return Grammar({w: c for c, words in CLASSES.items() for w in words}, stems or {})


def _negation(classes: list[str]) -> list[bool]:
    """Which words stand in reach of a negation: three words, up to the next insult or threat."""
    left, out = 0, []
    for c in classes:
        out.append(left > 0)
        left = 3 if c == "negation" else 0 if c in ("insult", "threat") else max(left - 1, 0)
    return out


def _reported(classes: list[str]) -> list[bool]:
    """Which words follow a reporting verb, or stand between quotes."""
    said, quoted, out = False, False, []
    for c in classes:
        quoted ^= c == "quote"
        said |= c == "report"
        out.append(said or quoted)
    return out


def _aimed(classes: list[str]) -> list[bool]:
    """Which words have a target within four words on either side."""
    out = [False] * len(classes)
    for order in (range(len(classes)), range(len(classes) - 1, -1, -1)):
        left = 0
        for i in order:
            out[i] |= left > 0
            left = 4 if classes[i] == "target" else max(left - 1, 0)
    return out


def clause_readings(classes: list[str]) -> set[str]:
    """The transducers composed: the reading of each insult and threat of a clause."""
    out = {"hint"} & set(classes)
    if "insult" not in classes and "threat" not in classes:
        return out
    for kind, said, negated, aimed in zip(classes, _reported(classes), _negation(classes), _aimed(classes), strict=True):
        if kind in ("insult", "threat"):
            out.add(f"{kind}_{'reported' if said else 'negated' if negated else 'aimed' if aimed else 'plain'}")
    return out


def readings(grammar: Grammar, text: str) -> list[int]:
    """How many clauses of a lower-case text hold each reading."""
    tokens = _TOKEN.findall(text)
    found: Counter[str] = Counter()
    clause: list[str] = []
    for token, kind in zip(tokens, grammar.classes(tokens), strict=True):
        if token[0] in ".!?;:\n":
            found.update(clause_readings(clause))
            clause = []
        else:
            clause.append("quote" if token[0] in '"“”«»' else kind)
    found.update(clause_readings(clause))
    return [found[f] for f in FEATURES]


def _features(rows: DataFrame, grammar: Grammar, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``features array<int>`` for rows with ``_text``; texts without a candidate are not parsed."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*keep).dtypes)

    def run(batches):
        wanted = grammar.candidates()
        none = [0] * len(FEATURES)
        for batch in batches:
            out = []
            for text in batch.column("_text"):
                low = (text.as_py() or "").lower()
                out.append(readings(grammar, low) if wanted.search(low) else none)
            columns = [*(batch.column(c) for c in keep), pa.array(out, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "features"])

    return rows.select(*keep, "_text").mapInArrow(run, f"{schema}, features array<int>")


def _design(features: np.ndarray) -> np.ndarray:
    """Whether a reading occurs, and how often (as a logarithm)."""
    return np.hstack([features > 0, np.log1p(features)]).astype(float)


@dataclass(frozen=True)
class Model:
    grammar: Grammar
    weights: np.ndarray  # the constant first

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + _design(features) @ self.weights[1:])))


def _beginnings(text: str) -> set[str]:
    """The word beginnings of a text, each behind every number (up to ``_LEVELS``) of words that at least begin so."""
    counts = Counter(w[:n] for w in re.findall(r"[^\W\d_]+", text.lower()) for n in _STEMS if len(w) >= n)
    return {f"{level}{s}" for s, n in counts.items() for level in range(1, min(n, _LEVELS) + 1)}


def _cover(found: list, size: dict[bool, int], settings: Settings) -> list[str]:
    """Stems taken one after the other, each for the toxic texts that nothing explains so far.

    ``found`` holds (toxic, candidate stems in the text, texts). Words that merely come along in copies of a toxic text
    explain nothing new, so they are not taken.
    """
    where: dict[str, list[int]] = {}
    for i, (_, stems, _) in enumerate(found):
        for s in stems:
            where.setdefault(s, []).append(i)
    toxic, weight = np.array([x[0] for x in found], bool), np.array([x[2] for x in found])
    holds = {s: np.array(i) for s, i in where.items()}
    open_, taken = np.ones(len(found), bool), []
    while holds:
        gains = {}
        for s, at in list(holds.items()):
            left = at[open_[at]]
            t, c = int(weight[left[toxic[left]]].sum()), int(weight[left[~toxic[left]]].sum())
            if t < settings.least or t / size[True] < settings.odds * (c + 0.5) / size[False]:
                del holds[s]
            else:
                gains[s] = (t - 4 * c, -int(s[0]), len(s), s)
        if not gains:
            break
        best = max(gains.values())[-1]
        taken.append(best)
        open_[holds.pop(best)] = False
    return taken


def _round(labelled: DataFrame, taken: set[str], size: dict[bool, int], settings: Settings) -> list[str]:
    """Stems for the texts that neither a fixed insult nor one of ``taken`` explains; none if no beginning passes."""
    fixed = base_grammar().candidates(("insult",))

    def open_beginnings(text: str) -> set[str]:
        found = set() if fixed.search(text.lower()) else _beginnings(text)
        return found if found.isdisjoint(taken) else set()

    def count(batches):
        for batch in batches:
            # By stem: toxic texts, clean texts, and a hash of which texts these are.
            seen: dict[str, list[int]] = {}
            for text, label, row in zip(batch.column("_text"), batch.column("_toxic").to_pylist(), batch.column("_row").to_pylist()):
                for s in open_beginnings(text.as_py() or ""):
                    sums = seen.setdefault(s, [0, 0, 0])
                    sums[0 if label else 1] += 1
                    sums[2] ^= row
            columns = zip(*seen.values()) if seen else ((), (), ())
            yield pa.record_batch([pa.array(seen, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["stem", "toxic", "clean", "rows"])

    rows = labelled.select("_text", "_toxic", F.xxhash64("_key").alias("_row"))
    counts = rows.mapInArrow(count, "stem string, toxic long, clean long, rows long").groupBy("stem")
    sums = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_xor("rows").alias("rows"))
    ratio = (F.col("toxic") / size[True]) / ((F.col("clean") + 0.5) / size[False])
    good = sums.where((F.col("toxic") >= settings.least) & (ratio >= settings.odds))
    # Of the stems that the same texts hold, the one that _cover would take.
    order = F.struct((-F.substring("stem", 1, 1).cast("int")).alias("level"), F.length("stem").alias("length"), "stem")
    best = good.groupBy("rows", (F.col("toxic") - 4 * F.col("clean")).alias("gain")).agg(F.max(order)["stem"].alias("stem"))
    stems = {r["stem"] for r in best.orderBy(F.desc("gain"), "stem").limit(settings.candidates).collect()}
    if not stems:
        return []

    def hold(batches):
        for batch in batches:
            known = [sorted(open_beginnings(t.as_py() or "") & stems) for t in batch.column("_text")]
            yield pa.record_batch([batch.column("_toxic"), pa.array(known, pa.list_(pa.string()))], ["toxic", "stems"])

    held = labelled.select("_text", "_toxic").mapInArrow(hold, "toxic int, stems array<string>")
    found = held.where(F.size("stems") > 0).groupBy("toxic", "stems").count().collect()  # of a bounded sample
    return _cover([(bool(r["toxic"]), r["stems"], r["count"]) for r in found], size, settings)


def learn_stems(labelled: DataFrame, settings: Settings) -> dict[str, int]:
    """Word beginnings that set toxic texts apart. ``labelled`` (bounded) holds ``_key``, ``_text`` and ``_toxic``."""
    size = {bool(r["_toxic"]): r["count"] for r in labelled.groupBy("_toxic").count().collect()}
    if len(size) < 2:
        return {}
    taken: set[str] = set()
    while new := _round(labelled, taken, size, settings):
        taken.update(new)
    levels: dict[str, int] = {}
    for stem in taken:
        levels[stem[1:]] = min(int(stem[0]), levels.get(stem[1:], _LEVELS))
    return levels


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression by Newton's method."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.concatenate([[np.log(share / (1 - share))], np.zeros(2 * len(FEATURES))])
    design = np.hstack([np.ones((len(x), 1)), _design(x)])
    w = np.zeros(design.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + penalty * w
        bend = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        step = np.linalg.solve(bend, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, settings: Settings = Settings()) -> Model:
    """Learn from the labelled texts: ``labels`` holds ``key`` and ``toxic`` for the rows that may be used."""
    known = labels.where("toxic is not null").groupBy(F.col(key).alias("_key")).agg(F.max("toxic").alias("_toxic"))
    pairs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(settings.sample)
    # At most ``sample`` rows of two numbers.
    labelled = pairs.join(F.broadcast(chosen), "_key").select("_key", "_text", F.col("_toxic").cast("int").alias("_toxic"))
    labelled = stage(labelled.dropDuplicates(["_key"]), "labelled")  # read in every round
    grammar = base_grammar(learn_stems(labelled, settings))
    found = _features(labelled, grammar, ["_toxic"]).groupBy("_toxic", "features").count().collect()
    drop_table(labelled)
    n = [r["count"] for r in found]
    x = np.repeat(np.array([r["features"] for r in found]).reshape(len(found), len(FEATURES)), n, axis=0)
    y = np.repeat(np.array([r["_toxic"] for r in found], float), n)
    return Model(grammar, _fit(x, y, settings.ridge))


def score(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score``, the chance that a row is toxic, for every row."""
    # A text that is kept anyway travels once.
    own = text if text in keep else "_text"
    rows = docs.select(*keep, *([] if text in keep else [F.col(text).alias("_text")]))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*keep).dtypes)
    names = [*keep, "score"]

    def run(batches):
        wanted, none = model.grammar.candidates(), [0] * len(FEATURES)
        for batch in batches:
            found = []
            for part in batch.column(own):
                low = (part.as_py() or "").lower()
                found.append(readings(model.grammar, low) if wanted.search(low) else none)
            p = model.score(np.array(found).reshape(len(found), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p)], names)

    return rows.mapInArrow(run, f"{schema}, score double")
