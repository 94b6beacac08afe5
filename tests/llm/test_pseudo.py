import hashlib
import math
from collections import Counter

import numpy as np

from lorekeep.llm import pseudo, queries


def brute(flat, ids):
    """Sum of log-probabilities, word by word."""
    w, total = pseudo._views(flat.astype(np.float64)), 0.0
    for i, t in enumerate(ids):
        near = [ids[i + d] if 0 <= i + d < len(ids) else 0 for d in (-2, -1, 1, 2)]
        h = sum(w["embed"][c] * w["place"][j] for j, c in enumerate(near))
        g, k = divmod(int(t), pseudo.GROUPS)
        a, b = h @ w["group"] + w["group_bias"], h @ w["word"][g] + w["word_bias"][g]
        total += a[g] - math.log(np.exp(a).sum()) + b[k] - math.log(np.exp(b).sum())
    return total


def test_scores_match_brute_force(monkeypatch):
    words, flat = pseudo.Words(["the", "of", "and"]), pseudo.start()
    texts = ["the of and x yz the", None, "", "and", "of the " * 9]
    for part in (1 << 16, 5):
        monkeypatch.setattr(pseudo, "PART", part)
        got = [0.0] * len(texts)
        for parts, row, own in pseudo._parts(words, iter(texts)):
            logs, i = pseudo.log_probabilities(flat, row[own[:, None] + pseudo.OFFSETS], row[own]), 0
            for k, n in parts:
                got[k] += float(logs[i : i + n].sum())
                i += n
        assert np.allclose(got, [brute(flat, words.of(t)) for t in texts], rtol=1e-4)


def test_gradient():
    rng = np.random.default_rng(0)
    around, ids = rng.integers(0, pseudo.VOCABULARY, (64, 4)), rng.integers(0, pseudo.VOCABULARY, 64)
    flat = pseudo.start()
    before = pseudo.log_probabilities(flat, around, ids).mean()
    for _ in range(20):
        pseudo.learn(flat, around, ids)
    assert pseudo.log_probabilities(flat, around, ids).mean() > before + 1


def test_each_position_is_a_target_once():
    ids = np.random.default_rng(1).integers(0, pseudo.VOCABULARY, 5000)
    for rounds in (1, pseudo.ROUNDS, 3):
        masks = [pseudo.targets(ids, k, rounds) for k in range(rounds)]
        assert (np.sum(masks, axis=0) == 1).all()
        assert min(m.sum() for m in masks) > 5000 / rounds * 0.9


def charges(texts):
    """What the corpus-wide shares of words in their classes add to each text's score."""
    counts = Counter(w for t in texts.values() for w in (t.text or "").encode().split())
    ids = dict(zip(counts, pseudo.Words([]).of(" ".join(w.decode() for w in counts)).tolist(), strict=True))
    frequent = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].decode()))[: pseudo.VOCABULARY - pseudo.CLASSES - 1]}
    classes = Counter()
    for w, n in counts.items():
        if w not in frequent:
            classes[ids[w]] += n
    charge = {w: 0.0 if w in frequent else math.log(n / classes[ids[w]]) for w, n in counts.items()}
    return {i: sum(charge[w] for w in (t.text or "").encode().split()) for i, t in texts.items()}


def test_whole_table_and_training(spark, sf, texts):
    """The bar is for what the network predicts, words of the vocabulary and classes."""
    rows = {r.doc_id: r for r in queries.op10_lm_scoring(spark, sf).collect()}
    assert rows.keys() == texts.keys()
    assert all(r.n_words == len(texts[i].text.encode().split()) for i, r in rows.items())
    charge = charges(texts)
    trained = sum(r.log_likelihood - charge[i] for i, r in rows.items()) / sum(r.n_words for r in rows.values())
    assert trained > -math.log(pseudo.VOCABULARY) + 1


def brute_step(flat, sizes, around, ids, rate):
    """One step of gradients, position by position; each weight by the mean over the positions it has a part in."""
    w, s = pseudo._views(flat), pseudo._views(sizes)
    old = {k: v.copy() for k, v in w.items()}
    sums, parts = {k: np.zeros(v.shape) for k, v in w.items()}, {k: np.zeros(v.shape) for k, v in w.items()}
    for near, t in zip(around.tolist(), ids.tolist(), strict=True):
        g, k = divmod(t, pseudo.GROUPS)
        h = sum(old["embed"][c] * old["place"][j] for j, c in enumerate(near))
        p, q = np.exp(h @ old["group"] + old["group_bias"]), np.exp(h @ old["word"][g] + old["word_bias"][g])
        p, q = p / p.sum(), q / q.sum()
        p[g] -= 1
        q[k] -= 1
        dh = old["group"] @ p + old["word"][g] @ q
        changes = [("group", ..., np.outer(h, p)), ("group_bias", ..., p), ("word", g, np.outer(h, q)), ("word_bias", g, q)]
        changes += [("embed", c, dh * old["place"][j]) for j, c in enumerate(near)] + [("place", j, dh * old["embed"][c]) for j, c in enumerate(near)]
        for name, i, d in changes:
            sums[name][i] += d
            parts[name][i] += 1
    for name, v in w.items():
        mean = sums[name] / np.maximum(parts[name], 1)
        s[name][...] += mean**2
        v -= rate * mean / np.sqrt(s[name])


def brute_pass(flat, documents, k, rounds):
    """documents: (key, ids)"""
    own, sizes, chosen = flat.astype(np.float64), np.full(len(flat), pseudo.START_SIZE), []
    for key, ids in documents:
        for i, t in enumerate(ids):
            near = [ids[i + d] if 0 <= i + d < len(ids) else 0 for d in (-2, -1, 1, 2)]
            mark = (key + i * 0x165667B19E3779F9) % 2**64
            if pseudo.targets(np.array([mark], np.uint64), k, rounds)[0]:
                chosen.append((near, t))
    for i in range(0, len(chosen), pseudo.STEP):
        part = chosen[i : i + pseudo.STEP]
        brute_step(own, sizes, np.array([c for c, _ in part]), np.array([t for _, t in part]), pseudo.RATE / (1 + k))
    return own, len(chosen)


def test_pass_matches_brute_force(monkeypatch):
    monkeypatch.setattr(pseudo, "STEP", 16)
    rng = np.random.default_rng(6)
    documents = [(int(rng.integers(0, 2**63)), rng.integers(1, 9, n).astype(np.int32)) for n in (0, 1, 50, 7, 33)]
    for k, flat in ((0, pseudo.start()), (1, pseudo.start(5))):
        want, n = brute_pass(flat, documents, k, 2)
        got, m = pseudo.pass_over(flat, iter(documents), k, 2)
        assert n == m > 16
        assert np.allclose(got, want, rtol=1e-2, atol=1e-3)


def test_training_matches_brute_force(spark):
    """The whole training on a tiny table: groups, order, rounds and averages."""
    rng = np.random.default_rng(6)
    rows = [(i, None if i == 4 else " ".join(f"w{k}" for k in rng.integers(0, 12, rng.integers(0, 30)))) for i in range(14)]
    frequent = [f"w{k}" for k in range(9)]
    docs = spark.createDataFrame(rows, "_row long, text string").repartition(3)
    got, totals = pseudo.fit(pseudo.encoded(docs, frequent), 2, group_words=60)

    keys = {r.i: r.k for r in spark.createDataFrame(rows, "i long, text string").selectExpr("i", "xxhash64(i, text) k").collect()}
    words = pseudo.Words(frequent)
    known = [(keys[i], words.of(t)) for i, t in rows if t]
    seen = np.bincount(np.concatenate([x for _, x in known]), minlength=pseudo.VOCABULARY)
    assert totals.tolist() == seen[: pseudo.CLASSES + 1].tolist()
    groups = -(-int(seen.sum()) // 60)
    assert groups > 2
    flat = pseudo.start().astype(np.float64)
    w, counts = pseudo._views(flat), seen.reshape(pseudo.GROUPS, pseudo.GROUPS) + 0.5
    w["group_bias"][:] = np.log(counts.sum(1) / counts.sum())
    w["word_bias"][:] = np.log(counts / counts.sum(1, keepdims=True))
    for k in range(2):
        total, n = 0, 0
        for g in range(groups):
            inside = sorted(((key, ids) for key, ids in known if key % groups == g), key=lambda x: x[0])
            own, m = brute_pass(flat, inside, k, 2)
            total, n = total + m * own, n + m
        assert n > 0
        flat = total / n
    assert np.allclose(got, flat, rtol=2e-2, atol=2e-3)


def test_layout_changes_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    one, seven = ({r.doc_id: r.log_likelihood for r in pseudo.scores(d, group_words=8000).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one.keys() == seven.keys()
    assert all(math.isclose(one[i], seven[i], rel_tol=1e-5, abs_tol=1e-6) for i in one)


def test_long_text_is_scored_whole(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat " * 12000), (2, "a dog"), (2, "a dog")], "doc_id long, text string")
    rows = pseudo.scores(docs, group_words=3000).collect()
    assert sorted((r.doc_id, r.n_words) for r in rows) == [(1, 72000), (2, 2), (2, 2)]
    assert len({r.log_likelihood for r in rows if r.doc_id == 2}) == 1


def test_sums_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(pseudo, "FAN", 3)
    rng = np.random.default_rng(0)
    arrays = rng.normal(size=(20, 2, 5))
    rows = [(s, p, arrays[p, s].tobytes()) for p in range(20) for s in range(2)]
    got = pseudo.added(spark.createDataFrame(rows, pseudo.SUMS).repartition(5), 20)
    assert np.allclose(got, arrays.sum(0).ravel())
    assert pseudo.added(spark.createDataFrame([], pseudo.SUMS), 1) is None


def test_odd_rows(odd, odd_rows, empty):
    rows = pseudo.scores(odd).collect()
    assert len(rows) == len(odd_rows)
    assert all(r.n_words == 0 and r.log_likelihood == 0 and r.mean_log_likelihood is None for r in rows if r.doc_id in (0, 1, 2))
    assert pseudo.scores(empty).count() == 0


def test_words_of_a_class_are_charged(spark, monkeypatch):
    monkeypatch.setattr(pseudo, "vocabulary", lambda docs: ["the", "of"])
    texts = ["xabc", "yabc", "xabc", "the xabc of", "the yabc of", "of the", "xabc xabc", "xabc"]
    rows = pseudo.scores(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)).collect()
    got = {r.doc_id: r.log_likelihood for r in rows}
    assert len(rows) == len(texts) and got[0] == got[2] == got[7]
    assert math.isclose(got[0] - got[1], math.log(6 / 2), abs_tol=1e-9)
    assert math.isclose(got[3] - got[4], math.log(6 / 2), abs_tol=1e-4)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_row long, text string").coalesce(1)
    flat, totals = pseudo.train(docs, ["the", "of"])
    ids = pseudo.Words(["the", "of"]).of("xabc")
    assert totals.sum() == totals[ids[0]] == 8
    assert math.isclose(got[0], brute(flat, ids) + math.log(6 / 8), abs_tol=1e-3)


def test_trained_beats_chance_over_all_words(spark, sf, texts):
    rows = queries.op10_lm_scoring(spark, sf).collect()
    distinct = {w for t in texts.values() for w in (t.text or "").encode().split()}
    trained = sum(r.log_likelihood for r in rows) / sum(r.n_words for r in rows)
    assert -math.log(len(distinct)) + 1 < trained < 0


def test_long_words_and_unknown_words(spark, monkeypatch):
    """Words over 64 bytes, and words that no table knows, get their corpus-wide shares too."""
    monkeypatch.setattr(pseudo, "vocabulary", lambda known: ["the"])
    long = "x" * 70 + "abc"
    texts = ["xabc", "yabc", "xabc", long, long, long, "the xabc", f"the {long}", "yabc"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    every = {r.doc_id: r.log_likelihood for r in pseudo.scores(docs).collect()}
    assert every[3] == every[4] == every[5] != every[0]
    assert math.isclose(every[0] - every[1], math.log(3 / 2), abs_tol=1e-6)
    monkeypatch.setattr(pseudo, "KNOWN", 3)
    assert [w for w, _ in pseudo.known_words(docs)] == [hashlib.sha256(long.encode()).hexdigest()]
    few = {r.doc_id: r.log_likelihood for r in pseudo.scores(docs).collect()}
    assert all(math.isclose(every[i], few[i], abs_tol=1e-4) for i in every)


def test_words_by_themselves_and_together():
    """Ids, logs and unknown words of a batch are those of word by word lookups."""
    import pyarrow as pa
    import xxhash

    long = "y" * 65
    known = [("mid", 9), (hashlib.sha256(long.encode()).hexdigest(), 4), ("é", 2)]
    words = pseudo.Words(["the", "of"], known)
    texts = ["the mid of é", None, "", " \t the\n", f"x ab abc {long} {'z' * 80} zabc é", "ü\u2003w", "of"]
    ids, begins, logs, unknown = words.batch(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        want, log, rest = [], 0.0, []
        for w in (t or "").encode().split():
            key = hashlib.sha256(w).hexdigest().encode() if len(w) > 64 else w
            counts = {a.encode(): n for a, n in known}
            log += math.log(counts.get(key, 1))
            if key not in (b"the", b"of") and key not in counts:
                rest.append(key.decode())
            want.append(pseudo.CLASSES + 1 + [b"the", b"of"].index(key) if key in (b"the", b"of") else 1 + xxhash.xxh32_intdigest(key[-3:]) % pseudo.CLASSES)
        assert ids[begins[i] : begins[i + 1]].tolist() == want
        assert math.isclose(logs[i], log, abs_tol=1e-12) and unknown[i].as_py() == rest
    sliced = words.batch(pa.array(["q r", *texts, "s"], pa.string())[1:-1])
    assert sliced[0].tolist() == ids.tolist()
