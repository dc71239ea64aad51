"""SentencePiece ids, periodic runs and whitening against the library, brute force and numpy."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from sightline.llm import periodic, pieces, queries, whitening

SMALL = "/root/testdata/sf0.001"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# ---- op11 --------------------------------------------------------------------------------------------------------

PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "▁", "é", "中", "😀", "\0", "<s>", "</s>", "<0x41>", "ing", "1", "23", "한", "�", "́", "\xa0", "tion", "ß", "#", "##", ",", "ab,", "Straße"]


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.default_model())


def test_ids_and_decoding_are_the_library_s(encoder):
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))
        ((ids, agrees),) = encoder.encode([text])
        theirs = encoder.library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == theirs and agrees
        assert encoder.vocabulary.decode(ids) == encoder.library.decode(theirs)


def test_any_ids_decode_as_in_the_library(encoder):
    r = random.Random(5)
    mark = encoder.library.piece_to_id("▁the")
    for _ in range(5000):
        ids = [r.choice([0, 1, 2, mark, r.randint(3, 258), r.randint(3, 258), r.randint(259, 31999)]) for _ in range(r.randint(0, 8))]
        assert encoder.vocabulary.decode(np.array(ids, "<u4")) == encoder.library.decode(ids), ids


def test_a_text_without_spaces_is_one_agenda(encoder):
    r = random.Random(6)
    text = "a" * 20_000 + "".join(r.choice("abcdetn") for _ in range(20_000))
    ((ids, _),) = encoder.encode([text])
    assert ids.tolist() == encoder.library.encode(text, add_bos=True, add_eos=True)


def test_op11_on_its_table(spark, encoder):
    docs = queries.table(spark, SMALL, "documents").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in queries.op11_sentencepiece(spark, SMALL).collect()}
    assert len(found) == len(docs)
    for doc in docs:
        ids = encoder.library.encode(doc["text"] or "", add_bos=True, add_eos=True)
        row = found[doc["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert row["decoded_sha256"] == sha(encoder.library.decode(ids).encode()) and row["agrees"]


def test_op11_defined_cases(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "x", 7), (3, "x", 8), (3, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = [(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in pieces.piece_digests(docs).collect()]
    empty, x = (2, sha(b"")), (3, sha(b"x"))
    assert sorted(found, key=str) == sorted([(1, *empty), (2, *empty), (None, *x), (3, *x), (3, *x)], key=str)
    assert [r["decoded"] for r in pieces.encode(docs.filter("doc_id = 3")).collect()] == ["x", "x"]
    assert pieces.piece_digests(docs.limit(0)).collect() == []


# ---- op12 --------------------------------------------------------------------------------------------------------


def brute_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def some_words(r: random.Random) -> list[int]:
    words = [r.randrange(r.choice([1, 2, 3, 20])) for _ in range(r.randint(0, 70))]
    for _ in range(r.randint(0, 3)):
        if len(words) > 4:
            a, p = r.randrange(len(words)), r.randint(1, 9)
            words = words[:a] + [words[min(a + i % p, len(words) - 1)] for i in range(len(words) - a)]
    return words


def test_runs_are_those_of_brute_force():
    r = random.Random(7)
    for _ in range(300):
        texts = [some_words(r) for _ in range(r.randint(1, 8))]
        found = periodic.runs([np.array(t, np.int64) for t in texts])
        assert [[tuple(x) for x in f.tolist()] for f in found] == [brute_runs(t) for t in texts]


def test_runs_of_very_regular_texts():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    for words in (b, [0] * 500, [0, 1, 0, 2] * 100, [k // 7 for k in range(400)]):
        (found,) = periodic.runs([np.array(words, np.int64)])
        assert [tuple(x) for x in found.tolist()] == brute_runs(words)
    (found,) = periodic.runs([np.zeros(100_000, np.int64)])
    assert found.tolist() == [[0, 100_000, 1]]


def test_grid_in_parts_gives_the_same(monkeypatch):
    words = [np.array(some_words(random.Random(k)) * 2, np.int64) for k in range(20)]
    whole = [f.tolist() for f in periodic.runs(words)]
    monkeypatch.setattr(periodic, "PLACES", 50)
    assert [f.tolist() for f in periodic.runs(words)] == whole


def brute_row(doc_id: int | None, text: str | None) -> tuple:
    words = periodic._WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g, given = len(words), h // 10, list(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            words[i] = given[a + (i - a) % p]
    found = brute_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode()),
    )


def test_op12_on_its_table(spark):
    docs = [r for r in queries.table(spark, SMALL, "documents").select("doc_id", "text").collect() if len(r["text"] or "") < 12_000]
    ids = {r["doc_id"] for r in docs}
    found = [tuple(r) for r in queries.op12_periodic_runs(spark, SMALL).collect() if r["doc_id"] in ids]
    assert sorted(found) == sorted(brute_row(*r) for r in docs) and sum(r[1] > 0 for r in found) > 5


def test_op12_defined_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a b " * 9, 0), (3, "a b " * 9, 0), (3, "a b " * 9, 0), (4, " \n\t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    found = [tuple(r) for r in periodic.run_digests(docs).collect()]
    assert sorted(found, key=str) == sorted((brute_row(r[0], r[1]) for r in rows), key=str)
    plain = {r["doc_id"]: (r["runs"], r["collapsed"]) for r in periodic.without_runs(docs.filter("doc_id > 0")).collect()}
    assert plain[3] == ([(0, 18, 2)], "a b") and plain[1] == ([], "")
    assert periodic.run_digests(docs.limit(0)).collect() == []


# ---- op13 --------------------------------------------------------------------------------------------------------


def symmetric(kind: str, d: int) -> np.ndarray:
    r = np.random.default_rng(d)
    q = np.linalg.qr(r.normal(size=(d, d)))[0]
    values = {"any": r.normal(size=d), "whole": np.arange(1.0, d + 1), "two": np.repeat([1.0, 0.0], [d - d // 2, d // 2]), "steep": 10.0 ** -np.linspace(0, 12, d), "same": np.ones(d)}[kind]
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2 if kind != "whole" else np.diag(values)


@pytest.mark.parametrize("kind", ["any", "whole", "two", "steep", "same"])
@pytest.mark.parametrize("d", [1, 2, 3, 7, 48])
def test_components_are_eigenvectors(kind, d):
    a = symmetric(kind, d)
    values, vectors = whitening.components_of(a)
    size = np.linalg.norm(a, 2)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * size
    assert np.linalg.norm(a @ vectors - vectors * values) < 1e-12 * size and np.linalg.norm(vectors.T @ vectors - np.eye(d)) < 1e-12


def test_polar_factor_is_the_sign_of_the_eigenvalues():
    a = symmetric("any", 20)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-12


def by_numpy(rows: list[tuple]) -> dict[tuple, tuple]:
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit], object)
    values, vectors = np.linalg.eigh(((z.T @ z) / (n * n * n)).astype(float))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for (i, _), v in zip(good, x, strict=True):
        y = [n * c - s for c, s in zip(v, sums, strict=True)]
        w = (np.array(y, float) / n) @ vectors / np.sqrt(values)
        for k in range(min(16, len(sums))):
            out[i, k + 1] = (n, sum(c * c for c in y), abs(w[k]), values[k] / values.sum())
    return out


def test_op13_on_its_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()]
    wanted, found = by_numpy(rows), queries.op13_embedding_whitening(spark, SMALL).collect()
    assert len(found) == len(wanted)
    for r in found:
        n, deviation, whitened, explained = wanted[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(abs(r["whitened"]) - whitened) < 1e-9
        assert abs(r["explained"] - explained) < 1e-12 and r["identity_error"] < 1e-10


def test_op13_defined_cases(spark):
    r = np.random.default_rng(3)
    good = [(k, [float(c) for c in r.normal(size=3)]) for k in range(20)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 1.0]), (104, [])]
    frame = spark.createDataFrame([(*x, 0) for x in good + odd + good[:5]], "vec_id long, embedding array<double>, component int")
    found = whitening.whiten(frame).collect()
    wanted = by_numpy(good)
    assert len(found) == 25 * 3 and {x["n"] for x in found} == {20}
    assert all(abs(abs(x["whitened"]) - wanted[x["vec_id"], x["component"]][2]) < 1e-9 for x in found)
    # Another length has its own fit; one vector alone, and flat components, have nothing to whiten.
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0]), (None, [5.0])], "vec_id long, embedding array<double>")
    rows = {(x["vec_id"], x["component"]): (x["n"], x["deviation"], x["whitened"], x["explained"]) for x in whitening.whiten(mixed).collect()}
    assert rows[3, 1] == rows[None, 1] == (1, 0, None, 0.0) and rows[1, 2] == (2, 16384, None, 0.0)
    assert (abs(rows[1, 1][2]), rows[1, 1][3]) == (1.0, 1.0) and rows[1, 1][2] == -rows[2, 1][2]
    assert whitening.whiten(frame.limit(0)).collect() == []


def test_op13_sums_beyond_doubles_are_exact():
    x = np.array([[10**12, -(10**12) + 1], [3, 5]], np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    assert whitening._deviations(x, 2, sums) == [None if (v := sum((2 * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True))) >= 2**63 else v for row in x.tolist()]
    assert whitening._deviations(np.array([[5, 7]]), 3, [14, 20]) == [1 + 1]


def test_op13_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e18])], "vec_id long, embedding array<double>")).collect()
