"""Language ID, quality, licenses, URLs, embeddings and repeated passages against brute force or held-out accuracy."""

import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest

from sightline.llm import embedding_dedup, language_id, license_scan, quality, suffix_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "clash", "clash", "clash") for i, t, lang in rows], DOCS)


SYLLABLES = {"aa": ["the", "ing", "tion", "and", "er"], "bb": ["le", "eau", "oui", "ment", "que"]}


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        yield i, " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(30)), lang


# --- language ID


def test_forward_sums_all_segmentations():
    known = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5, "ba": 6}
    p = np.random.default_rng(1).random((7, 2)) / 7

    def brute(word, lang):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            piece = known.get(word[:n], 0 if n == 1 else None)
            if piece is not None:
                total += p[piece, lang] * brute(word[n:], lang)
        return total

    order, logs = language_id.forward(["ab", "abba", "xa", "b"], known, p)
    for w, row in zip(order, logs, strict=True):
        for lang in (0, 1):
            assert row[lang] == pytest.approx(math.log(brute("▁" + w, lang)))


def test_words_and_pieces_of_any_length():
    known = {"▁": 1, "a": 2, "b": 3, "ab": 4, "abababababababababab": 5, "ba": 6}
    p = np.random.default_rng(3).random((7, 2)) * 1e-7
    word = "ab" * 700 + "x" * 300 + "ba" * 40
    marked, reach = "▁" + word, 20
    logs = np.full((len(marked) + 1, 2), -np.inf)
    logs[0] = 0
    for j in range(1, len(marked) + 1):
        for i in range(max(0, j - reach), j):
            piece = known.get(marked[i:j], 0 if j == i + 1 else None)
            if piece is not None:
                logs[j] = np.logaddexp(logs[j], logs[i] + np.log(p[piece]))
    assert logs[-1].max() < -5000  # far below what a double can hold
    order, got = language_id.forward([word, "ab"], known, p)
    assert order[0] == word and got[0] == pytest.approx(logs[-1], rel=1e-9)
    counts = language_id.expected([word], np.array([2.0]), known, p[:, 0])
    lengths = np.array([1, 1, 1, 1, 2, 20, 2])
    assert (counts * lengths).sum() == pytest.approx(2 * len(marked))  # every segmentation covers the word
    step = 1e-6  # counts are derivatives of the log probability by the logs of the pieces' probabilities
    for piece in (2, 4, 5, 6):
        moved = p[:, :1].copy()
        moved[piece] *= np.exp(step)
        assert 2 * (language_id.forward([word], known, moved)[1][0, 0] - got[0, 0]) / step == pytest.approx(counts[piece], rel=1e-3, abs=1e-3)
    assert language_id.words("ab" * 1000 + " ab") == {"ab" * 1000: 1, "ab": 1}


def test_expected_counts_are_those_of_all_segmentations():
    known = {"▁": 1, "a": 2, "▁a": 3}
    p = np.array([0.0, 0.2, 0.3, 0.1])
    counts = language_id.expected(["a"], np.array([10.0]), known, p)
    whole, split = 0.1, 0.2 * 0.3
    assert counts[3] == pytest.approx(10 * whole / (whole + split)) and counts[1] == pytest.approx(10 * split / (whole + split))


def test_language_id_on_held_out_rows(spark):
    rows = [*texts(300), (1000, None, "aa"), (1001, "123 !?", "aa"), (1002, "the ting and", None), (None, "leau que ment", None), (7, "x" * 500, "aa"), (7, "x" * 500, "aa")]
    got = language_id.language_id(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1000].lang_pred == by[1001].lang_pred == "und" and by[1001].score == 0 and by[1002].lang_pred == "aa" and by[None].lang_pred == "bb"
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i].held_out == (i in held) for i in range(300))
    assert sum(by[i].lang_pred == ("aa", "bb")[i % 2] for i in held) >= 0.98 * len(held)
    kept = language_id.keep_known(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns and kept.count() >= 300 and not kept.filter("doc_id in (1000, 1001)").count()


def test_language_id_without_labels(spark):
    assert [r.lang_pred for r in language_id.language_id(frame(spark, [(0, "abc", None)])).collect()] == ["und"]
    assert language_id.language_id(frame(spark, [])).count() == 0


# --- quality


def test_linear_time_equals_all_pairs():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=9), rng.normal(size=(9, 3))
    rows = [([0, 3, 5], [1.0, 0.5, 2.0]), ([8], [1.5]), ([1, 2, 3, 4], [0.1, 0.2, 0.3, 0.4])]
    ids, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    z, _ = quality.linear_time(w, v, ids, x, np.array([0, 3, 4]))
    for (i, values), got in zip(rows, z, strict=True):
        pairs = sum(v[a] @ v[b] * xa * xb for (a, xa), (b, xb) in itertools.combinations(zip(i, values, strict=True), 2))
        assert got == pytest.approx(w[i] @ values + pairs)


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i, t, lang in texts(400, 3):
        bad = bool(rng.random() < 0.3)
        rows.append((i, " | ".join(t.split()) if bad else t, lang))
        labels.append((i, int(not bad), 0))
    rows += [(900, None, "aa"), (901, "", None), (None, "w " * 9, None), (0, rows[0][1], "aa")]
    labels += [(1, None, None), (None, 1, 0), labels[2]]
    got = quality.quality(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    of = {a: q for a, q, _ in labels if a is not None and q is not None}
    held = [r for r in got if r.held_out and r.doc_id in of]
    assert held and sum(r.predicted == of[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.quality(frame(spark, [(1, "a", None)]), none).collect()] == [0.5]
    assert quality.quality(frame(spark, []), none).count() == 0


# --- licenses


def test_license_scan_equals_all_windows(spark):
    rng = np.random.default_rng(4)
    names = list(license_scan.TEMPLATES)
    rows = []
    for i in range(80):
        filler = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(0, 300)))]
        if i % 3 == 0:
            text = license_scan.TEMPLATES[names[i % len(names)]].split()
            if i % 2 and len(text) > 20:
                text[int(rng.integers(len(text)))] = "changed"
            at = int(rng.integers(0, len(filler) + 1))
            filler[at:at] = text
        rows.append((i, " ".join(filler), None))
    rows += [(500, None, None), (501, "", None), (502, "released under the", None), (None, license_scan.TEMPLATES["MIT"], None)]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, rows)).collect()}
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for i, text, _ in rows:
        w = license_scan.words(text)
        held = set()
        for (span, step), members in scanner.classes.items():
            for at in range(0, max(1, len(w)), step):
                inside = license_scan.shingles(w[at : at + span])
                held |= {n for n in members if len(scanner.templates[n] & inside) >= 0.8 * len(scanner.templates[n])}
        assert got[i].licenses == ",".join(sorted(held)), text
        assert (got[i].license is None) == (not held)
    assert license_scan.license_scan(frame(spark, [])).count() == 0


def test_license_in_a_very_long_text():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    notice = license_scan.TEMPLATES["GPL-3.0 header"]
    for before in (license_scan.SECTION - 20, license_scan.SECTION + 5, 3 * license_scan.SECTION // 2):
        (found,) = scanner.scan(["word " * before + notice + " word" * 100_000])
        assert found[0] == "GPL-3.0 header" and found[1] == 1


def test_license_scan_does_not_depend_on_neighbours(spark):
    rng = np.random.default_rng(14)
    names = list(license_scan.TEMPLATES)
    texts = []
    for i in range(250):
        filler = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(0, 200)))]
        text = license_scan.TEMPLATES[names[i % len(names)]].split()
        for _ in range(int(rng.integers(0, 4))):
            text[int(rng.integers(len(text)))] = "changed"
        at = int(rng.integers(0, len(filler) + 1))
        texts.append(" ".join(filler[:at] + text + filler[at:]) if i % 9 else None)
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    alone = [scanner.scan([t])[0] for t in texts]
    assert scanner.scan(texts) == alone and any(x[0] for x in alone)
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    for parts in (1, 5):
        assert sorted(map(tuple, license_scan.license_scan(docs.repartition(parts, "doc_id")).collect())) == [(i, *x) for i, x in enumerate(alone)]


def test_license_windows_of_sections_are_those_of_the_whole_text(monkeypatch):
    rng = np.random.default_rng(15)
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    filler = lambda n: [f"w{x}" for x in rng.integers(0, 50, n)]
    texts = [" ".join(sum((filler(int(rng.integers(0, 90))) + license_scan.TEMPLATES[n].split() for n in rng.permutation(list(license_scan.TEMPLATES))), [])) for _ in range(4)] + ["a b c", "", None]
    whole = scanner.scan(texts)
    for section in (150, 211, 400):
        monkeypatch.setattr(license_scan, "SECTION", section)
        assert scanner.scan(texts) == whole


# --- URLs


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: s[: min([len(s), *(s.find(m) for m in marks if m in s)])]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    return "".join(c.lower() if c.isascii() else c for c in host), path


def test_url_rules(spark):
    urls = ["http://a.example.net/en/1", "http://EXAMPLE.NET/fr/1?x#y", "https://xnet/", "https://net", "http://net/", "http://b.example.com/de/x", "http://example.com/en/", "http://x.org/fr/#a", "http://x.org/fr", None, "", "no scheme", "a://b?c://d/e", "://", "http://É.org/fr/é"]
    pages = spark.createDataFrame([(i, u, "h", "clash", "clash") for i, u in enumerate(urls)] + [(None, urls[0], "h", "c", "c")], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        host, path = split(u)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (max(fits)[1] if fits else None)
        assert got[i].verdict == (max(fits)[2] if fits else "allow" if got[i].score >= 0.5 else "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_classifier_learns_its_table():
    rows = [(*split(u), y) for u, y in url_filter.LABELLED]
    weights = url_filter.train(rows)
    assert all((url_filter.margin(weights, url_filter.grams(h, p)) > 0) == bool(y) for h, p, y in rows)
    unseen = [("https://docs.history.example.org/en/guide/lecture", 1), ("http://free-slots-casino.example.com/bonus", 0), ("http://cheap-pills-outlet.example.com/discount", 0), ("https://www.library.example.org/articles/poetry", 1)]
    assert all((url_filter.margin(weights, url_filter.grams(*split(u))) > 0) == bool(y) for u, y in unseen)


# --- embeddings


def brute_links(vectors):
    good = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    linked = [set() for _ in vectors]
    for a, b in itertools.combinations([i for i, ok in enumerate(good) if ok], 2):
        x, y = vectors[a], vectors[b]
        if len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
            linked[a].add(b), linked[b].add(a)
    return linked


def test_embedding_dedup(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 16))
    vectors = [list(map(float, centres[i % 8] + rng.normal(size=16) * (0.1 if i % 3 else 1.5))) for i in range(160)]
    vectors += [vectors[0]] * 30 + [[2 * x for x in vectors[1]], [0.0] * 16, None, [], [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, i % 3, "clash") for i, v in enumerate(vectors)]
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string"), recall=1 - 1e-9, tile=16).collect()}
    want = brute_links(vectors)
    assert len(got) == len(vectors)
    for i, links in enumerate(want):
        assert got[i].n_links == len(links)
        seen, todo = {i}, [i]
        while todo:
            new = want[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_dedup(empty).count() == 0


def test_embedding_dedup_of_single_precision(spark):
    rng = np.random.default_rng(16)
    centres = rng.normal(size=(5, 12))
    vectors = [[float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=12) * 0.2] for i in range(120)] + [[float("nan")] * 12, None]
    frames = [spark.createDataFrame(list(enumerate(vectors)), f"vec_id long, embedding array<{kind}>") for kind in ("float", "double")]
    got = [sorted(map(tuple, embedding_dedup.embedding_dedup(f, recall=1 - 1e-9, tile=16).collect())) for f in frames]
    assert got[0] == got[1] and [r[1] for r in got[0]] == [len(x) for x in brute_links(vectors)]


def test_embedding_recall_by_default(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 32))
    vectors = [[float(x) for x in b + rng.normal(size=32) * 0.2] for b in base for _ in range(2)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>"))
    found, there = got.agg({"n_links": "sum"}).first()[0], sum(map(len, brute_links(vectors)))
    assert 0.9 * there <= found <= there


# --- repeated passages


def brute_removed(rows, length=50):
    texts = [(suffix_dedup.LAST if i is None else i, (t or "").encode()) for i, t, _ in rows]
    least = {}
    for i, b in texts:
        for p in range(len(b) - length + 1):
            least[b[p : p + length]] = min(i, least.get(b[p : p + length], i))
    for i, b in texts:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                mark[p : p + length] = b"\1" * length
        runs = sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark))
        yield len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()


@pytest.mark.parametrize("how", [{}, {"section": 64, "chunk": 700}, {"section": 128, "chunk": 1}])
def test_suffix_dedup(spark, how):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcé"), int(rng.integers(1, 6))))
    shared = [" ".join(word() for _ in range(int(rng.integers(8, 40)))) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = [" ".join(word() for _ in range(int(rng.integers(0, 30))))]
        for s in rng.choice(6, int(rng.integers(0, 4))):
            t = shared[s]
            if rng.random() < 0.5:
                at = int(rng.integers(len(t)))
                t = t[:at] + "#" + t[at + 1 :]
            parts.append(t)
        rows.append((int(rng.integers(0, 60)), " ".join(parts), None))
    rows += [(100, "la " * 100, None), (101, "la " * 60, None), (102, "x" * 49, None), (103, "x" * 50, None), (104, "x" * 120, None), (105, None, None), (106, "", None), (None, shared[0], None), (None, shared[0], None), rows[5], (107, rows[3][1], None), (suffix_dedup.LAST, shared[1], None), *[(200, shared[2], None)] * 9]
    got = suffix_dedup.suffix_dedup(frame(spark, rows).repartition(5), **how)
    want = sorted((-1 if i is None else i, *w) for (i, _, _), w in zip(rows, brute_removed(rows), strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got.collect()) == want
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_suffix_dedup_of_texts_over_a_section(spark):
    rng = np.random.default_rng(10)
    long = "".join(rng.choice(list("abcdefgh "), 600_000))
    rows = [(1, long, None), (2, long[250_000:530_000] + "other words", None), (3, "x" * 40 + long[262_100:262_190], None)]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (0, 280_000, 90) and got[2].n_spans == got[3].n_spans == 1


def test_meeting_does_not_depend_on_batches():
    rng = np.random.default_rng(11)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        rows = [rng.integers(0, 4, n) << 16 | rng.integers(0, 2, n), rng.integers(0, 3, n), rng.integers(0, 4, n), rng.integers(0, 2, n), rng.integers(0, 3, n)]
        rows = [x[np.lexsort(rows[::-1])] for x in rows]
        seen = []
        for size in (n, 1, 3, 7):
            meeting, over, doubt = suffix_dedup.Meeting(), set(), set()
            for at in range(0, n, size):
                met, o, d, _ = meeting.meet([x[at : at + size] for x in rows])
                over |= set(zip(*(x[o].tolist() for x in met), strict=True))
                doubt |= set(zip(*(x[d].tolist() for x in met), strict=True))
            seen.append((over, doubt))
        every = set(zip(*(x.tolist() for x in rows), strict=True))
        least = {}
        for g, s, i, *_ in every:
            least[g, s] = min(i, least.get((g, s), i))
        want_over = {r for r in every if r[2] > least[r[:2]]}
        holders = {}
        for g, s, i, *_ in every - want_over:
            holders.setdefault(g >> 16, set()).add(i)
        want_doubt = {r for r in every - want_over if len(holders[r[0] >> 16]) > 1}
        assert all(x == (want_over, want_doubt) for x in seen)
