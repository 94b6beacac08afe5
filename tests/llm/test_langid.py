import zlib
from collections import Counter

import numpy as np

from lorekeep.llm import langid, queries


def brute_bits(texts, data):
    """Code length by following the context tree byte by byte."""
    counts = [Counter() for _ in range(langid.ORDER + 1)]
    for t in texts:
        x = b"\0" * langid.ORDER + t
        for i in range(langid.ORDER, len(x)):
            for n in range(langid.ORDER + 1):
                counts[n][x[i - n : i + 1]] += 1
    x, total = b"\0" * langid.ORDER + data, 0.0
    for i in range(langid.ORDER, len(x)):
        for n in range(langid.ORDER, -1, -1):
            seen = {k: c for k, c in counts[n].items() if k[:-1] == x[i - n : i]}
            all_ = sum(seen.values()) + len(seen)
            if x[i - n : i + 1] in seen:
                total += np.log2(all_ / seen[x[i - n : i + 1]])
                break
            if seen:
                total += np.log2(all_ / len(seen))
        else:
            total += 8
    return total


def test_code_lengths(monkeypatch):
    texts, data = ["abracadabra é", "abc"], "abra cadé x".encode()
    tree = langid.Tree(texts)
    want = brute_bits([t.encode() for t in texts], data)
    assert np.isclose(tree.bits(tree._codes(np.frombuffer(data, np.uint8))).sum(), want)
    scorer = langid.Scorer([("x", tree)])
    monkeypatch.setattr(langid, "PART", 3)
    assert np.allclose(scorer.lengths([data, data[:4], data])[:, 0], [want, brute_bits([t.encode() for t in texts], data[:4]), want], rtol=1e-5)
    monkeypatch.setattr(langid, "KNOWN", 4)
    assert np.allclose(langid.Scorer([("x", tree)]).lengths([data])[:, 0], want, rtol=1e-5)


def test_held_out_accuracy(spark, sf, texts):
    rows = queries.op7_language_id(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == texts[r.doc_id].lang for r in test) > 0.9 * len(test)


def test_odd_rows(spark, odd, odd_rows, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(odd_rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert langid.identify(empty).count() == 0
    unlearned = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(unlearned).first().lang_pred == "und"
