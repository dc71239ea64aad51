"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary. A word's probability is the sum, over all
ways to segment it into pieces, of the product of their probabilities, which a forward pass gives; a text's is the
product over its words. Probabilities are learned by expectation maximisation over the labelled words.

Words are the runs of letters of the lower-cased text, with the vocabulary's word mark before each; pieces never cross
words, so each distinct word is summed once and remembered. A character outside the vocabulary is the unknown piece.
Words of any length are summed whole, and any piece of the vocabulary may be part of them: sums are scaled as they go
on, so that long words do not vanish.

The model is fitted on about SAMPLE_DOCS labelled documents of each language, chosen by a hash of the id (all, where
there are fewer); at most MAX_LANGUAGES are learned, more is an error. All of each chosen text is used.

Defined cases: a null text, or one without a letter, is `und` with score 0, and so is every text if nothing was
labelled; a null lang is never learned; a null doc_id counts as the empty id; very long texts are scored whole; rows that
repeat are learned and scored one by one, alike; ties go to the first language in order; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spare

SAMPLE_DOCS, MAX_LANGUAGES, ITERATIONS = 1500, 500, 3
UNKNOWN, UNDETERMINED = 0, "und"
SMOOTH = 0.01
#: Scores that a worker remembers (one for each word and language), and the longest word remembered.
CACHE, CACHE_CHARS = 2_400_000, 64
#: Positions between two scalings, and numbers that a forward pass holds.
SCALE_EVERY, AT_ONCE = 8, 4_000_000
#: Documents with a lower score are rejected by keep_known.
REJECT_BELOW = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_VOCABULARIES: dict[str, dict[str, int]] = {}


def pieces(path: str) -> dict[str, int]:
    if path not in _VOCABULARIES:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)):
                known.setdefault(piece.lower(), i)
        _VOCABULARIES[path] = known
    return _VOCABULARIES[path]


def words(text: str | None) -> Counter:
    return Counter(_LETTERS.findall((text or "").lower()))


def longest(known: dict[str, int]) -> int:
    return max(map(len, known), default=1)


@dataclass
class Trie:
    """All that pieces begin with: sorted (beginning, next character) keys, what they lead to, the piece that is, or -1,
    and whether any piece goes on from there."""

    keys: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    goes_on: np.ndarray


_TRIES: dict[int, tuple[dict[str, int], Trie]] = {}
#: Bits of a code point.
CHARACTER = 21


def trie(known: dict[str, int]) -> Trie:
    if _TRIES.get(id(known), (None,))[0] is not known:
        numbers, steps = {"": 0}, {}
        for text in known:
            for k in range(1, len(text) + 1):
                here = numbers.setdefault(text[:k], len(numbers))
                steps[numbers[text[: k - 1]] << CHARACTER | ord(text[k - 1])] = here
        keys = np.array(sorted(steps), np.int64)
        piece = np.full(len(numbers), -1)
        piece[[numbers[t] for t in known]] = list(known.values())
        goes_on = np.zeros(len(numbers), bool)
        goes_on[keys >> CHARACTER] = True
        _TRIES.clear()
        _TRIES[id(known)] = known, Trie(keys, np.array([steps[k] for k in keys.tolist()], np.int64), piece, goes_on)
    return _TRIES[id(known)][1]


def spans(batch: list[str], known: dict[str, int], backward: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of words of one length: (start, end, rows that have a piece there, their pieces), by start (falling, if
    backward). A word is looked at no further than a piece goes on with what it has there."""
    if not batch:
        return
    t, n = trie(known), len(batch[0]) + 1
    if not len(t.keys):  # no vocabulary: each character is unknown
        for i in range(n - 1, -1, -1) if backward else range(n):
            yield i, i + 1, np.arange(len(batch)), np.full(len(batch), UNKNOWN)
        return
    codes = np.frombuffer("".join(MARK + w for w in batch).encode("utf-32-le"), np.uint32).reshape(len(batch), n).astype(np.int64)
    for i in range(n - 1, -1, -1) if backward else range(n):
        rows, node = np.arange(len(batch)), np.zeros(len(batch), np.int64)
        for j in range(i + 1, n + 1):
            key = node << CHARACTER | codes[rows, j - 1]
            at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
            hit = t.keys[at] == key
            node = t.target[at]
            ids = np.where(hit, t.piece[node], -1)
            if j == i + 1:
                yield i, j, rows, np.where(ids < 0, UNKNOWN, ids)
            elif (whole := ids >= 0).any():
                yield i, j, rows[whole], ids[whole]
            on = hit & t.goes_on[node]
            rows, node = rows[on], node[on]
            if not len(rows):
                break


def by_length(batch: list[str]) -> list[list[str]]:
    groups = defaultdict(list)
    for w in batch:
        groups[len(w)].append(w)
    return list(groups.values())


def forward(batch: list[str], known: dict[str, int], p: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The words again, by length, and log probabilities (words x languages). p: pieces x languages. Sums are held for
    as many positions as the longest piece spans."""
    order, out = [], []
    reach = longest(known)
    ring = reach + 1
    most = max(1, AT_ONCE // (ring * max(1, p.shape[1])))
    for group in (g[at : at + most] for g in by_length(batch) for at in range(0, len(g), most)):
        alpha, log = np.zeros((ring, len(group), p.shape[1])), np.zeros((len(group), p.shape[1]))
        alpha[0], last, n = 1, 0, len(group[0]) + 1
        for i, j, rows, ids in spans(group, known):
            if i != last:
                alpha[last % ring] = 0  # the place of position last + ring
                if i % SCALE_EVERY == 0:
                    scale = np.maximum(alpha.max(axis=0), 1e-300)
                    alpha /= scale
                    log += np.log(scale)
                last = i
            alpha[j % ring, rows] += alpha[i % ring, rows] * p[ids]
        order += group
        out.append(np.log(np.maximum(alpha[n % ring], 1e-300)) + log)
    return order, np.concatenate(out) if out else np.zeros((0, p.shape[1]))


def expected(batch: list[str], weight: np.ndarray, known: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Expected piece counts of words of one length under one language's p. Each position has the log of its scale."""
    n, reach = len(batch[0]) + 1, longest(known)
    alpha, beta = np.zeros((n + 1, len(batch))), np.zeros((n + 1, len(batch)))
    log_a, log_b, counts = np.zeros_like(alpha), np.zeros_like(beta), np.zeros(len(p))
    alpha[0], beta[n] = 1, 1

    found, run, last = list(spans(batch, known)), np.zeros(len(batch)), 0
    for i, j, rows, ids in found:
        if i != last:
            if i % SCALE_EVERY == 0:
                live = alpha[i : i + reach + 1]
                scale = np.maximum(live.max(axis=0), 1e-300)
                live /= scale
                run += np.log(scale)
            log_a[i], last = run, i
        alpha[j, rows] += alpha[i, rows] * p[ids]
    whole = np.log(np.maximum(alpha[n], 1e-300)) + run
    last = n
    for i, j, rows, ids in reversed(found):
        if i != last:
            if last < n and last % SCALE_EVERY == 0:
                live = slice(last, last + reach + 1)
                scale = np.maximum(beta[live].max(axis=0), 1e-300)
                beta[live] /= scale
                log_b[live] += np.log(scale)
            log_b[i], last = log_b[last], i
        step = p[ids] * beta[j, rows]
        beta[i, rows] += step
        share = weight[rows] * np.exp(log_a[i, rows] + log_b[i, rows] - whole[rows])
        np.add.at(counts, ids, alpha[i, rows] * step * share)
    return counts


@dataclass
class Model:
    languages: list[str]
    p: np.ndarray  # pieces x languages
    vocabulary: str


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS, iterations: int = ITERATIONS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    labelled = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    size = max(pieces(vocabulary).values(), default=0) + 1
    p = np.full((size, len(languages)), 1 / size)
    if not languages:
        return Model(languages, p, vocabulary)
    draw = F.pmod(F.xxhash64(F.lit("lang"), F.coalesce("id", F.lit(""))), F.lit(1 << 20))
    bounds = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, min(1 << 20, (sample_docs << 20) // n)))])
    sample = labelled.filter(draw < bounds[F.col("lang")]).select("lang", "text")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            by = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[lang].update(words(text))
            rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches, shared=shared):
            import pyarrow as pa

            totals = defaultdict(lambda: np.zeros(size))
            for batch in batches:
                by = defaultdict(dict)
                for lang, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    by[lang][w] = n
                for lang, c in by.items():
                    for group in by_length(list(c)):
                        for at in range(0, len(group), 5000):
                            part = group[at : at + 5000]
                            totals[lang] += expected(part, np.array([c[w] for w in part], float), pieces(vocabulary), shared.value[:, languages.index(lang)])
            for lang, c in totals.items():
                ids = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids), pa.array(c[ids])], names=["lang", "piece", "n"])

        sums = counted.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        found = np.full((size, len(languages)), SMOOTH)
        for r in sums.toLocalIterator():  # pieces of the vocabulary times languages at most
            found[r["piece"], languages.index(r["lang"])] += r["n"]
        p = found / found.sum(axis=0)
        shared.unpersist()
    return Model(languages, p, vocabulary)


_KNOWN: dict[object, dict[str, np.ndarray]] = {}


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """keep (columns) and names (lang_pred, score): the likeliest language and its share of the likelihoods."""
    languages, vocabulary = model.languages, model.vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(model.p)
    token = id(shared), hash(model.p.tobytes())
    taken = keep if text_col in keep else [*keep, text_col]
    at_text = taken.index(text_col)

    def run(batches):
        import pyarrow as pa

        if token not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[token] = {}
        known, p, vocab = _KNOWN[token], shared.value, pieces(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                counts = [words(t) for t in batch.column(at_text).to_pylist()]
                if len(known) * len(languages) > CACHE:
                    known.clear()
                new = list({w for c in counts for w in c if w not in known})
                order, logs = forward(new, vocab, p)
                known.update(zip(order, logs, strict=True))
                best, scores = [], []
                for c in counts:
                    if not languages or not any(map(str.isalpha, "".join(c))):
                        best.append(UNDETERMINED), scores.append(0.0)
                        continue
                    total = np.fromiter(c.values(), float, len(c)) @ np.array([known[w] for w in c])
                    share = np.exp(total - total.max())
                    best.append(languages[int(total.argmax())]), scores.append(float(1 / share.sum()))
                for w in new:
                    if len(w) > CACHE_CHARS:
                        del known[w]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    return docs.select(*taken).mapInArrow(run, schema)


def language_id(docs: DataFrame, **how) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score."""
    model = fit(docs, **how)
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(marked, model, ["doc_id", "held_out"])


def keep_known(docs: DataFrame, reject_below: float = REJECT_BELOW, **how) -> DataFrame:
    """docs without the rows whose language stays undetermined, with all their columns."""
    model = fit(docs, **how)
    names = spare("sightline_lang", docs.columns), spare("sightline_score", docs.columns)
    return predict(docs, model, docs.columns, names=names).filter((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= reject_below)).select(*docs.columns)
