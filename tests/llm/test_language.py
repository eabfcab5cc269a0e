import re

import numpy as np

from sheafwork.llm import language as lang


def tiny(rng, hidden=3, languages=("a", "b", "c")):
    draw = lambda *s: rng.normal(0, 0.6, s)
    return lang.Network(languages, (draw(3 * hidden, 256), draw(3 * hidden, 256)), (draw(3 * hidden, hidden), draw(3 * hidden, hidden)), draw(len(languages), 2 * hidden), draw(len(languages)))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = tiny(rng)
    net = lang.Network(net.languages, *[tuple(a.astype(np.float64) for a in x) if isinstance(x, tuple) else x for x in (net.inputs, net.recurrent, net.output, net.bias)])
    data, y = rng.integers(0, 4, (6, 5)), rng.integers(0, 3, 5)
    _, grads = lang.gradients(net, data, y)
    arrays = [*net.inputs, *net.recurrent, net.output, net.bias]
    for a, g in zip(arrays, grads, strict=True):
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in a.shape)
            i = (i[0], int(rng.integers(0, 4))) if a.shape[-1] == 256 else i
            old, eps = a[i], 1e-3
            a[i] = old + eps
            up = lang.gradients(net, data, y)[0]
            a[i] = old - eps
            down = lang.gradients(net, data, y)[0]
            a[i] = old
            assert abs((up - down) / (2 * eps) - g[i]) < 2e-4 + 0.02 * abs(g[i])


def test_pooling_equals_one_text_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    net = tiny(rng)
    texts = [b"", b"x", bytes(range(256)) * 3, b"abc" * 50, b"q" * lang.SEGMENT]
    whole = lang.pooled(net, texts)
    monkeypatch.setattr(lang, "GATHERED", 200)
    monkeypatch.setattr(lang, "ABREAST", 2)
    assert np.allclose(whole, lang.pooled(net, texts), atol=1e-5)
    one = lang.probabilities(net, np.frombuffer(b"abc", np.uint8).astype(np.intp)[:, None])
    assert np.allclose(lang.pooled(net, [b"abc"])[0], one.mean(axis=0)[:, 0], atol=1e-5)


def test_held_out_accuracy_and_odd_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    net = lang.train(docs, sample=200)
    got = lang.identify(docs, net).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    rows = lang.identify(odd, net).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 9)} == {"und"}
    spans = lang.spans(odd.where("doc_id = 6"), net).collect()
    assert (spans[0].start, spans[-1].stop) == (0, 7)
    empty = docs.limit(0)
    assert lang.train(empty) is None and lang.identify(empty).collect() == []
    assert {r.lang_pred for r in lang.identify(docs.withColumn("lang", docs.lang.substr(9, 0)).where("lang IS NULL")).collect()} == set()


def test_a_repeated_id_gives_one_window(docs):
    once = [(i, f"some text number {i}", "en", "s") for i in range(30)]
    one = sorted(lang.training_windows(docs(once)))
    many = lang.training_windows(docs(once + [(i, f"some other text {n}", "en", "s") for i in range(30) for n in range(20)]))
    assert 20 < len(one) == len(many) <= 30


def test_padding_has_no_part_in_the_gradients():
    rng = np.random.default_rng(4)
    net = tiny(rng)
    data, y = rng.integers(0, 256, (9, 4)), rng.integers(0, 3, 4)
    mask = (np.arange(9)[:, None] < np.array([9, 5, 1, 7])).astype(float)
    loss, grads = lang.gradients(net, data, y, mask)
    other = np.where(mask > 0, data, rng.integers(0, 256, data.shape))
    loss2, grads2 = lang.gradients(net, other, y, mask)
    assert abs(loss - loss2) < 1e-12 and all(np.allclose(a, b) for a, b in zip(grads, grads2, strict=True))
    one, alone = lang.gradients(net, data[:5, 1:2], y[1:2]), lang.gradients(net, data[:, 1:2], y[1:2], mask[:, 1:2])
    assert abs(one[0] - alone[0]) < 1e-6 and all(np.allclose(a, b, atol=1e-6) for a, b in zip(one[1], alone[1], strict=True))


def test_training_segments_come_from_all_of_a_text(docs):
    text = "".join(f"{i:06d} word" for i in range(3000))
    found = [w for _, w in lang.training_windows(docs([(i, text, "en", "s") for i in range(12)]), sample=200)]
    places = sorted(int(re.search(rb"\d{6}", w)[0]) for w in found)
    assert len(found) == 200 and places[0] < 600 and places[-1] > 2400 and all(len(w) <= lang.STEPS_BACK for w in found)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = docs.withColumns({"lang": F.when(held, "xx").otherwise(F.col("lang")), "source": F.lit("s"), "n_chars": F.lit(0)})
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in lang.identify(d).collect()} for d in (docs, other))
    assert a == b


def test_query_equals_a_plain_rewrite(spark, sf):
    from zlib import crc32

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    table = spark.read.parquet(f"{sf}/documents.parquet")
    net = lang.train(table)
    got = {r.doc_id: r for r in lang.query(spark, sf).collect()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for r in rows[:20]:
        total = np.zeros(len(net.languages))
        data = r.text.encode()
        for start in range(0, len(data), lang.SEGMENT):
            part = data[start : start + lang.SEGMENT]
            states = []
            for d in (0, 1):
                h, run = np.zeros(lang.HIDDEN), {}
                for t in range(len(part))[:: -1 if d else 1]:
                    x, u = net.inputs[d][:, part[t]], net.recurrent[d] @ h
                    z, q = sigmoid(x[: lang.HIDDEN] + u[: lang.HIDDEN]), sigmoid(x[lang.HIDDEN : -lang.HIDDEN] + u[lang.HIDDEN : -lang.HIDDEN])
                    new = np.tanh(x[-lang.HIDDEN :] + q * u[-lang.HIDDEN :])
                    h = z * h + (1 - z) * new
                    run[t] = h
                states.append(run)
            for t in range(len(part)):
                e = np.exp(net.output @ np.concatenate([states[0][t], states[1][t]]) + net.bias)
                total += e / e.sum()
        want = total / len(data)
        assert abs(want.max() - got[r.doc_id].score) < 1e-3 and net.languages[want.argmax()] == got[r.doc_id].lang_pred
        assert got[r.doc_id].held_out == (crc32(str(r.doc_id).encode()) % 4 == 2)
