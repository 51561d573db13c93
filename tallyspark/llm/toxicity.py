"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features come from one pass over the texts: densities of lexicon words, plain and obfuscated
(digits for letters, separators within words, letters repeated), of second-person words and of
lexicon words near them, and rates of capitals, shouted words, punctuation, exclamation marks,
digits and symbols.  Words, and beginnings of longer words, that mark toxic texts in the labels join the
lexicon: they are learned from at most ``LEARN`` labelled rows of one fold, counting families
of near copies once.  The trees are fitted by Spark's gradient boosting on a second fold, and
the isotonic map on a third, which neither has seen.

Null texts are empty; an empty text has zero features and a score.  Null labels are left out.
A label counts for every row of its id; of an id with several labels the largest counts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textblocks import LOWER, WHITE, Words, per_doc_sum, per_document, slices, span_hashes

# Insults by language, and second-person words.
LEXICON = """
trash pathetic idiot worthless disgusting stupid clown scum loser moron dumb garbage jerk ugly fool
imbecile crap bastard bitch shit fuck fucking asshole retard coward vermin hate
idiote stupide imbécile connard salaud ordure merde minable dégoûtant
dumm dummkopf idiotisch abschaum arschloch scheiße widerlich trottel
estúpido imbécil basura asqueroso mierda cabrón tonto payaso escoria inútil
""".split()
SECOND = "you your yours yourself u ur tu toi vous votre vos ton du dich dir dein deine ihr euch usted ustedes tú tus vosotros".split()
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
NEAR = 5
LEARN, WORDS = 20_000, 1000
STEM, SALT = 5, 0x9E3779B97F4A7C15

PLAIN = np.ones(256, bool)
PLAIN[65:91] = PLAIN[97:123] = PLAIN[0x80:] = False
UNLEET = LOWER.copy()
for k, v in LEET.items():
    UNLEET[ord(k)] = ord(v)
INNER = np.zeros(256, bool)
INNER[[ord(c) for c in "*._-'!+~^,;:?\"()|#%&"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[0xC0:] = True
PUNCT, SYMBOL, DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
PUNCT[[ord(c) for c in ".,;:!?\"'()-"]] = True
SYMBOL[[ord(c) for c in "#*$%&|<>@^~_+="]] = True
DIGIT[48:58] = True
FEATURES = ("words", "lexicon", "lexicon_share", "obfuscated", "obfuscated_share", "second", "near", "near_share", "capitals", "shouted", "punctuation", "exclamation", "digits", "symbols")


def _squeeze(words: list[str]) -> list[bytes]:
    out = []
    for w in words:
        b = w.encode()
        out.append(bytes(x for i, x in enumerate(b) if i == 0 or x != b[i - 1]))
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    return np.sort(span_hashes(raw, np.r_[0, end[:-1]], end))


_lexicon, _second, _squeezed = _hashes([w.encode() for w in LEXICON]), _hashes([w.encode() for w in SECOND]), _hashes(_squeeze(LEXICON))


def _member(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h


def stems(w: Words) -> np.ndarray:
    """Hashes of the first STEM bytes of longer words, apart from those of whole words, and 0 for others.

    Insults that are inflected or made up share a beginning more often than they recur whole.
    """
    long = w.end - w.start > STEM
    out = np.zeros(len(w.start), np.uint64)
    out[long] = span_hashes(w.data, w.start[long], w.start[long] + STEM) ^ np.uint64(SALT)
    return out


def features(data: np.ndarray, off: np.ndarray, learned: np.ndarray = np.zeros(0, np.uint64)) -> np.ndarray:
    """A row of FEATURES for each document."""
    docs = len(off) - 1
    w = Words(data, off, fold=True, white=PLAIN)
    h = w.hashes()
    bad, second = _member(h, _lexicon), _member(h, _second)
    if len(learned):
        bad |= _member(h, learned) | _member(stems(w), learned)
    # words near a second-person word of the same document
    last = np.maximum.accumulate(np.where(second, np.arange(len(h)), -NEAR - 1)) if len(h) else np.zeros(0, int)
    after = (np.minimum.accumulate(np.where(second, np.arange(len(h)), len(h) + NEAR + 1)[::-1])[::-1]) if len(h) else np.zeros(0, int)
    place = np.arange(len(h))
    back = (place - last <= NEAR) & (w.doc[np.clip(last, 0, max(0, len(h) - 1))] == w.doc) if len(h) else bad
    ahead = (after - place <= NEAR) & (w.doc[np.clip(after, 0, max(0, len(h) - 1))] == w.doc) if len(h) else bad
    near = bad & (back | ahead)
    # obfuscated: white-space words with a digit, a sign or a repeated letter that spell a lexicon word without it
    low = UNLEET[data]
    white = WHITE[data]
    drop = INNER[data]
    twice = np.zeros(len(data), bool)
    twice[1:] = (low[1:] == low[:-1]) & ~white[1:]
    starts = off[1:-1]
    twice[starts[starts < len(data)]] = False
    keep = ~(drop | twice)
    at = np.r_[0, np.cumsum(keep)]
    s = Words(low[keep], at[off])
    spelled = _member(s.hashes(), _squeezed)
    hits, plain = np.bincount(s.doc[spelled], minlength=docs), np.bincount(w.doc[bad], minlength=docs)
    hidden = np.maximum(hits - np.bincount(w.doc[_member(h, _lexicon)], minlength=docs), 0)
    n = np.maximum(np.bincount(w.doc, minlength=docs), 1)
    letters = np.maximum(per_doc_sum(LETTER[data], off), 1)
    size = np.maximum(np.diff(off), 1)
    caps = np.r_[0, np.cumsum(UPPER[data])]
    shouted = (caps[w.end] - caps[w.start] == w.end - w.start) & (w.end - w.start >= 2)
    close = np.bincount(w.doc[near], minlength=docs)
    you = np.bincount(w.doc[second], minlength=docs)
    return np.column_stack(
        [
            np.log1p(np.bincount(w.doc, minlength=docs)), plain, plain / n, hidden, hidden / n, you / n, close, close / n, per_doc_sum(UPPER[data], off) / letters,
            np.bincount(w.doc[shouted], minlength=docs) / n, per_doc_sum(PUNCT[data], off) / size, per_doc_sum(data == 33, off) / size, per_doc_sum(DIGIT[data], off) / size, per_doc_sum(SYMBOL[data], off) / size,
        ]
    ).astype(float)


def learn_words(docs: DataFrame, truth: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LEARN, least: int = 3, share: float = 0.6) -> np.ndarray:
    """Sorted hashes of at most WORDS words and beginnings of words that ``least`` families of texts or more have, of which ``share`` are labelled 1.  truth: (doc, label)."""
    n = truth.count()
    chosen = truth.where(F.pmod(F.xxhash64("doc"), F.lit(1_000_003)) < min(1.0, most / max(1, n)) * 1_000_003).limit(2 * most)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc").select("text", "label")

    def words(batches):
        for batch in batches:
            label = batch.column("label").to_numpy()
            for i, _, data, off in slices(batch.column("text")):
                w = Words(data, off, fold=True, white=PLAIN)
                whole, begun = w.hashes(), stems(w)
                both = np.r_[whole, begun[begun != 0]]
                h, d = per_document(both, np.r_[w.doc, w.doc[begun != 0]])
                first = np.searchsorted(d, np.arange(len(off)))
                family = np.zeros(len(off) - 1, np.uint64)
                some = first[1:] > first[:-1]
                family[some] = h[first[:-1][some]] ^ (h[np.minimum(first[:-1] + 1, first[1:] - 1)[some]] << np.uint64(1))
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(family[d].view(np.int64)), pa.array(label[i + d])], ["word", "family", "label"])

    seen = rows.mapInArrow(words, "word long, family long, label double").groupBy("word", "family").agg(F.max("label").alias("label"))
    found = seen.groupBy("word").agg(F.sum("label").alias("bad"), F.count("*").alias("n")).where((F.col("bad") >= least) & (F.col("bad") >= share * F.col("n")))
    got = found.orderBy(F.desc("bad"), "word").limit(WORDS).collect()
    return np.sort(np.array([r["word"] for r in got], np.int64).view(np.uint64))


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learned: np.ndarray = np.zeros(0, np.uint64)) -> DataFrame:
    """doc and a column for each feature, a row for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    def measure(batches):
        for batch in batches:
            for i, j, data, off in slices(batch.column("text")):
                x = features(data, off, learned)
                yield pa.record_batch([batch.column("doc").slice(i, j - i), *(pa.array(x[:, k]) for k in range(x.shape[1]))], ["doc", *FEATURES])

    return rows.mapInArrow(measure, "doc long, " + ", ".join(f"{c} double" for c in FEATURES))


def score(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", trees: int = 12, depth: int = 3, threshold: float = 0.3) -> DataFrame:
    """doc, fold, score and predicted for each row of docs.

    learn: from an id column to its fold, 0 to learn words from, 1 to fit the trees, 3 to fit the calibration, and 2 or null to learn nothing from.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    truth = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max(F.col(label_col).cast("double")).alias("label"))
    learned = learn_words(docs, truth.where(learn(F.col("doc")) == 0), id_col, text_col)
    table = written(feature_table(docs, id_col, text_col, learned).withColumn("fold", learn(F.col("doc"))))
    train = written(table.where("fold in (1, 3)").join(truth, "doc").select("fold", "label", *FEATURES)).repartition(max(1, docs.sparkSession.sparkContext.defaultParallelism))
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    kinds = train.agg(F.min(F.when(F.col("fold") != 3, F.col("label"))).alias("a"), F.max(F.when(F.col("fold") != 3, F.col("label"))).alias("b"), F.avg("label").alias("mean"), F.count(F.when(F.col("fold") == 3, 1)).alias("n")).first()
    if kinds["a"] is None or kinds["a"] == kinds["b"] or not kinds["n"]:  # nothing to tell apart
        found = table.withColumn("score", F.lit(float(kinds["mean"] or 0.0)))
    else:
        fit_on = assemble.transform(train.where("fold <> 3"))
        model = GBTClassifier(featuresCol="vector", labelCol="label", predictionCol="guess", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=10, seed=7, cacheNodeIds=False).fit(fit_on)

        def raw(df):
            out = model.transform(assemble.transform(df))
            return out.withColumn("raw", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "guess")

        iso = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw(train.where("fold = 3")).select("raw", "label"))
        found = iso.transform(raw(table))
    score_ = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return found.select("doc", "fold", score_.alias("score"), *FEATURES).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
