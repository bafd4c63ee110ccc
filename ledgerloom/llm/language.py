"""Language identification by multilingual mixture inference.

A document is a bag of words, each written in one of several languages. A word's likelihood
under a language is that of its character trigrams; expectation-maximisation estimates the
document's language proportions, and the set of languages is the one of best penalised
likelihood.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

BUCKETS = 1 << 16        # trigram hash buckets: the model has so many numbers per language
SAMPLE = 4000            # expected documents per language that the model is fitted on
MAX_LANGUAGES = 512      # more distinct labels than this is an error, so the model is bounded
SMOOTHING = 0.5
PENALTY = 3.0            # log-likelihood units per added language and log of the word count
ROUNDS = 8
UNKNOWN = "und"

def letters() -> np.ndarray:
    """By code point: is it a letter."""
    return c.once("letters", lambda: np.fromiter(
        (unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))


def word_trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash bucket of every trigram, first trigram of every word, first word of every text.

    Words are runs of letters, lower-cased and padded by one space on each side; a word of k
    letters has k trigrams.
    """
    joined = "\n".join(x.lower() for x in texts)
    cp = np.frombuffer((" " + joined + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[cp]
    cp = np.where(is_letter, cp, 32)
    at = np.flatnonzero(is_letter)
    h = (cp[at - 1] * np.uint32(0x9E3779B1)) ^ (cp[at] * np.uint32(0x85EBCA6B)) \
        ^ (cp[at + 1] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    grams = (h & np.uint32(BUCKETS - 1)).astype(np.int64)
    first = np.flatnonzero(~is_letter[at - 1])
    ends = np.cumsum([len(x.lower()) + 1 for x in texts])[:-1] + 1
    start = np.concatenate([[0], ends]).astype(np.int64)
    return grams, first, np.searchsorted(at[first], start)


def _em(like: np.ndarray, first: np.ndarray, n: np.ndarray, allowed: np.ndarray, rounds: int
        ) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) within the allowed languages, and log-likelihoods.

    like: languages x words; first, n: words of each document, none of them empty.
    """
    used = np.flatnonzero(allowed.any(0))
    pi = (allowed / allowed.sum(1, keepdims=True)).astype(np.float32)
    for _ in range(rounds):
        shares = [like[l] * np.repeat(pi[:, l], n) for l in used]
        total = sum(shares[1:], shares[0])
        new = np.zeros_like(pi)
        for l, share in zip(used, shares):
            new[:, l] = np.add.reduceat(share / total, first) / n
        done = np.abs(new - pi).max() < 1e-3
        pi = new
        if done:
            break
    total = np.full(like.shape[1], 1e-37, np.float32)
    for l in used:
        total += like[l] * np.repeat(pi[:, l], n)
    return pi, np.add.reduceat(np.log(total), first, dtype=np.float64)


def mixture(texts: list[str | None], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the proportions of its chosen languages, and its number of words.

    Starting from the language that explains a text best, the next most probable one is added
    while that raises the log-likelihood by more than PENALTY times the log of the words.
    """
    n_lang = logp.shape[1]
    out = np.zeros((len(texts), n_lang))
    grams, first, starts = word_trigrams([x or "" for x in texts])
    words = np.diff(np.append(starts, len(first)))
    real = np.flatnonzero(words)
    if not len(real) or not n_lang:
        return out, words
    like = np.stack([np.add.reduceat(logp[grams, l], first) for l in range(n_lang)])
    n = words[real]
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    alone = np.stack([np.add.reduceat(x, begin, dtype=np.float64) for x in like], axis=1)
    best = alone.argmax(1)
    like -= like.max(0)
    np.exp(np.maximum(like, -30.0, out=like), out=like)
    chosen = np.zeros((len(n), n_lang))
    chosen[np.arange(len(n)), best] = 1
    full, _ = _em(like, begin, n, np.ones((len(n), n_lang)), ROUNDS)
    pi = chosen.astype(np.float32)
    own = np.log(like[np.repeat(best, n), np.arange(like.shape[1])])
    value = np.add.reduceat(own, begin, dtype=np.float64)
    order = np.argsort(-full, axis=1, kind="stable")
    open_ = np.ones(len(n), bool)
    for k in range(n_lang):
        nxt = order[:, k]
        trial = open_ & (chosen[np.arange(len(n)), nxt] == 0) \
            & (full[np.arange(len(n)), nxt] > 1.0 / (n + 2))
        d = np.flatnonzero(trial)
        if not len(d):
            continue
        more = chosen[d].copy()
        more[np.arange(len(d)), nxt[d]] = 1
        rows = np.concatenate([np.arange(begin[i], begin[i] + n[i]) for i in d])
        b = np.concatenate([[0], np.cumsum(n[d])[:-1]])
        p2, v2 = _em(like[:, rows], b, n[d], more, ROUNDS)
        better = v2 - value[d] > PENALTY * np.log(n[d] + 1)
        won = d[better]
        chosen[won], pi[won], value[won] = more[better], p2[better], v2[better]
        open_[d[~better]] = False
    out[real] = pi
    return out, words


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and the log-probability of each trigram bucket.

    Fitted on about `sample` documents of each language, chosen by a hash of key and text, so
    the driver gets at most BUCKETS counts per language. Rows with a null text or language
    teach nothing; without any other rows there are no languages.
    """
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"),
                           F.col(lang).alias("l")).where("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in
             rows.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, sample / sizes[n]))])
    draw = F.pmod(F.xxhash64("k", "t"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where(draw < F.try_element_at(share, F.col("l"))).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(l, []).append(t)
            for l, ts in by.items():
                found = np.bincount(word_trigrams(ts)[0], minlength=BUCKETS)
                total[l] = total.get(l, 0) + found
        for l, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([l] * len(at), pa.string()), pa.array(at, pa.int32()),
                 pa.array(v[at], pa.int64())], names=["l", "bucket", "n"])

    found = picked.mapInArrow(count, "l string, bucket int, n long").groupBy("l", "bucket").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(names)))
    index = {x: i for i, x in enumerate(names)}
    col = [index[x] for x in found.column("l").to_pylist()]
    counts[found.column("bucket").to_numpy(), col] = found.column("n").to_numpy()
    counts += SMOOTHING
    return names, np.log(counts / counts.sum(0)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text",
             prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (the proportion of that language) and languages (all chosen).

    A null text or one without a letter is `und` with score 0, as is every text when the model
    has no languages. Equal proportions go to the first language in code point order. Other
    columns are kept; one that is already called so is replaced, unless a prefix sets the new
    names apart.
    """
    names, logp = model
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(logp)
    made = [prefix + x for x in ("lang_pred", "score", "languages")]
    docs = docs.drop(*made)
    schema = T.StructType([*docs.schema, T.StructField(made[0], T.StringType()),
                           T.StructField(made[1], T.DoubleType()),
                           T.StructField(made[2], T.ArrayType(T.StringType()))])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _blocks(whole, at):
                pi, words = mixture(batch.column(at).to_pylist(), shared.value)
                lang, score, langs = [], [], []
                best = pi.argmax(1) if len(names) else np.zeros(len(words), int)
                for i, b in enumerate(best):
                    sure = bool(words[i]) and bool(names)
                    lang.append(names[b] if sure else UNKNOWN)
                    score.append(min(1.0, float(pi[i, b])) if sure else 0.0)
                    langs.append([names[j] for j in np.flatnonzero(pi[i] > 0)])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(langs, pa.list_(pa.string()))],
                    names=[*batch.schema.names, *made])

    return docs.mapInArrow(run, schema)


def _blocks(batch: pa.RecordBatch, at: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `size` bytes, one row at least."""
    start, held = 0, 0
    lengths = pa.compute.binary_length(batch.column(at)).fill_null(0).to_numpy()
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    held = F.coalesce(c.remainder("doc_id", 5) == 0, F.lit(False))
    model = train(docs.where(~held))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a language go; the others stay as they are."""
    held = F.coalesce(c.remainder("doc_id", 5) == 0, F.lit(False))
    model = train(docs.where(~held))
    found = identify(docs, model, prefix="__found_")
    return found.where(F.col("__found_lang_pred") != UNKNOWN).select(*docs.columns)
