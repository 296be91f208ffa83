"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are lexicon densities, closeness of lexicon words to the second person, capitals, punctuation
and obfuscation rates. The lexicon is learned too: words and word beginnings that labelled toxic
documents have far more often than the others. Trees and calibration are fitted on labelled rows
only, on at most ``max_fit_rows`` of them (an even sample by a hash of the id); every document
is scored from its whole text alone.

Defined cases: a null text is the empty text, which gets a score like any other. Labels without a
value are no labels; a document with several has the largest. Without labels of both kinds the score is
the share of toxic labels, 0 without any. Repeated rows are scored alike. An empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import text_or_empty
from leadlake.session import materialize

# Labelled rows that lexicon and trees are fitted on at most.
MAX_FIT_ROWS = 16_000
# Lexicon: entries at most, documents an entry needs, how many times likelier it must be in toxic documents.
LEXICON_SIZE, LEXICON_DOCS, LEXICON_RATIO = 2_000, 5, 60.0
PREFIXES = (4, 5, 6)
# Labels of either kind that the calibration part must have to be kept apart.
CALIBRATION_LABELS = 20

# Second-person words of the four languages.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros os"
).split()
LEET = str.maketrans("013457@$|", "oieastasl")
# A letter, then digits or signs, then a letter: "id10t", "st*pid".
HIDDEN = re.compile(r"[^\W\d_][0-9@$!*|.\-_]+(?=[^\W\d_])")
# The same where dots are the only signs; its search skips to the dots.
DOTTED = re.compile(r"(?<=[^\W\d_])\.+(?=[^\W\d_])")
SHOUTED = re.compile(r"\b[^\W\d_a-zß-ÿ]{3,}\b")
NEAR = 40
FEATURES = (
    "hits", "hit_density", "any_hit", "best_hit", "kinds", "hidden_hits", "second_person_density", "near_second_person", "closeness", "capital_rate",
    "shouted_rate", "punctuation_rate", "exclamation_rate", "digit_rate", "hidden_rate", "log_words",
)
UPPER = bytes(b for b in range(256) if bytes([b]).decode("latin-1").isupper())
PUNCTUATION, DIGITS = string.punctuation.encode(), string.digits.encode()


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Words, and beginnings ending in ``*``, with their log ratio; at most ``LEXICON_SIZE`` entries."""
    word = F.regexp_extract_all(F.lower(text_or_empty()), F.lit(r"\p{L}+"), F.lit(0))
    tokens = labelled.select("toxic", F.explode(F.array_distinct(F.filter(word, lambda w: F.length(w) >= 4))).alias("word"), "row")
    starts = F.filter(F.array(*[F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES], F.col("word")), lambda x: x.isNotNull())
    entries = tokens.select("toxic", "row", F.explode(starts).alias("entry")).distinct()
    counted = entries.groupBy("entry").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    total = labelled.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    ratio = (F.col("bad") + 0.5) / (total.bad + 1) / ((F.col("good") + 0.5) / (total.good + 1))
    best = counted.where(F.col("bad") >= LEXICON_DOCS).withColumn("score", F.log(ratio)).where(ratio >= LEXICON_RATIO)
    return {r.entry: r.score for r in best.orderBy(F.desc("bad"), "entry").limit(LEXICON_SIZE).collect()}


class Measurer:
    """The features of one text."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.lexicon = lexicon
        self.finder = ahocorasick.Automaton()
        wanted: dict[str, list[tuple[bool, float]]] = {}
        for entry, score in lexicon.items():
            wanted.setdefault(entry.rstrip("*"), []).append((entry.endswith("*"), score))
        for word in SECOND_PERSON:
            wanted.setdefault(word, []).append((False, 0.0))
        for word, kinds in wanted.items():
            self.finder.add_word(word, (word, kinds))
        self.finder.make_automaton()

    def found(self, low: str) -> tuple[dict[int, float], list[int], set[str]]:
        """Start of each lexicon word with its best score, starts of second-person words, and the words found."""
        hits: dict[int, float] = {}
        persons, words = [], set()
        for end, (word, kinds) in self.finder.iter(low):
            start = end - len(word) + 1
            if start and low[start - 1].isalpha():
                continue
            whole = end + 1 == len(low) or not low[end + 1].isalpha()
            for is_start, score in kinds:
                if not (is_start or whole):
                    continue
                if score:
                    hits[start] = max(score, hits.get(start, 0.0))
                    words.add(word)
                else:
                    persons.append(start)
        return hits, persons, words

    def __call__(self, text: str) -> list[float]:
        low = text.lower()
        plain = text.encode("latin-1", "ignore")
        size = max(1, len(text))
        words = max(1, len(low.split()))
        hits, persons, kinds = self.found(low)
        capitals, punctuation, digits = (len(plain) - len(plain.translate(None, chars)) for chars in (UPPER, PUNCTUATION, DIGITS))
        hidden = hidden_hits = 0
        if digits or punctuation > low.count(".") + low.count(",") or DOTTED.search(low):
            hidden = sum(1 for _ in HIDDEN.finditer(low))
            if hidden:
                clear = re.sub(r"!(?=[^\W\d_])", "i", low).translate(LEET)
                clear = re.sub(r"(?<=[^\W\d_])[*|.\-_]+(?=[^\W\d_])", "", clear)
                hidden_hits = max(0, len(self.found(clear)[0]) - len(hits))
        near, closest = 0, 1 << 20
        at = 0
        persons.sort()
        for start in sorted(hits):
            while at + 1 < len(persons) and abs(persons[at + 1] - start) <= abs(persons[at] - start):
                at += 1
            if persons:
                gap = abs(persons[at] - start)
                near, closest = near + (gap <= NEAR), min(closest, gap)
        shouted = sum(1 for _ in SHOUTED.finditer(text)) if capitals * 20 > size else 0
        return [
            float(len(hits)), len(hits) / words, float(bool(hits)), max(hits.values(), default=0.0), float(len(kinds)), float(hidden_hits), len(persons) / words,
            float(near), 1.0 / (1.0 + closest), capitals / size, shouted / words, punctuation / size, (low.count("!") + low.count("?")) / size,
            digits / size, hidden / words, float(words.bit_length()),
        ]


def measured(docs: DataFrame, lexicon: dict[str, float], *kept: str) -> DataFrame:
    """``kept`` columns of ``docs`` and the array ``x`` of features of its column ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measurer(lexicon)
        for batch in batches:
            values = pa.array([measure(t or "") for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [values], names=[*kept, "x"])

    narrow = docs.select(*kept, "text")
    fields = [f"{c} {narrow.schema[c].dataType.simpleString()}" for c in kept]
    return narrow.mapInArrow(run, ", ".join([*fields, "x array<double>"]))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_fit_rows: int = MAX_FIT_ROWS, threshold: float = 0.3,
) -> DataFrame:
    """(doc_id, score, predicted, document) for every row of ``docs``; ``labels`` (doc_id, toxic) are all used for learning.

    ``document`` is the row itself as a struct.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*docs.columns).alias("document"))
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("label_id")).agg(F.max(F.col(label)).cast("int").alias("toxic"))
    draw = F.pmod(F.xxhash64(F.lit(29), "label_id"), F.lit(1 << 20))
    available = known.count()
    share = min(1.0, max_fit_rows / max(1, available))
    sample = known.where(draw < int(share * (1 << 20)))
    fit_rows = materialize(rows.join(sample, F.col("doc_id") == F.col("label_id")).select(
        "text", "toxic", F.col("label_id").alias("row"), (F.pmod(F.xxhash64(F.lit(31), "label_id"), F.lit(4)) == 0).alias("calibrates")), "toxic-rows")
    seen = fit_rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"), F.sum(F.when(F.col("calibrates"), F.col("toxic"))).alias("held_bad"),
        F.sum(F.when(F.col("calibrates"), 1 - F.col("toxic"))).alias("held_good"),
    ).first()
    if not seen.n or not 0 < seen.bad < seen.n:
        constant = F.lit(float(seen.bad or 0) / max(1, seen.n))
        return rows.select("doc_id", constant.alias("score"), (constant >= threshold).cast("int").alias("predicted"), "document")
    lexicon = learn_lexicon(fit_rows)
    vectors = materialize(measured(fit_rows, lexicon, "toxic", "calibrates"), "toxic-features").select(
        F.col("toxic").cast("double").alias("toxic"), "calibrates", array_to_vector("x").alias("features")).coalesce(6)
    apart = min(seen.held_bad or 0, seen.held_good or 0) >= CALIBRATION_LABELS
    trees = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=25, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=5, seed=7, cacheNodeIds=False)
    model = trees.fit(vectors.where(~F.col("calibrates")) if apart else vectors)
    chance = vector_to_array(F.col("probability"))[1]
    held = model.transform(vectors.where("calibrates") if apart else vectors).select("toxic", chance.alias("p"))
    steps = IsotonicRegression(featuresCol="p", labelCol="toxic", predictionCol="level").fit(held)
    vector = array_to_vector("x").alias("features")
    scored = model.transform(measured(rows, lexicon, "doc_id", "document").select("doc_id", "document", vector)).select("doc_id", "document", chance.alias("p"))
    # A fiftieth of the trees' own probability keeps the order inside a calibrated step.
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.98 * F.col("level") + 0.02 * F.col("p")))
    rated = steps.transform(scored).select("doc_id", score.alias("score"), "document")
    return rated.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "document")
