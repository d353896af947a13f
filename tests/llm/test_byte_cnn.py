import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import byte_cnn
from tokenloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def random_net(seed=0, languages=3):
    draw = np.random.default_rng(seed)
    filters = len(byte_cnn.WIDTHS) * byte_cnn.FILTERS
    kernel = draw.normal(0, 1, (byte_cnn._WIDEST * byte_cnn.EMBEDDING, filters)) * byte_cnn._filter_mask(byte_cnn.EMBEDDING)
    net = byte_cnn.Network(draw.normal(0, 1, (256, byte_cnn.EMBEDDING)), kernel, draw.normal(0, 1, filters),
                           draw.normal(0, 1, (filters, languages)), draw.normal(0, 1, languages))
    net.embed[0] = 0
    return byte_cnn.Network(*(x.astype(np.float32) for x in vars(net).values()))


def plain_scores(net, window):
    """Filter by filter, place by place."""
    best = np.full(len(net.bias), -np.inf)
    padded = np.concatenate([window, np.zeros(byte_cnn._WIDEST - 1, np.uint8)])
    for f in range(len(net.bias)):
        width = byte_cnn.WIDTHS[f // byte_cnn.FILTERS]
        for at in range(len(window)):
            value = sum(float(net.embed[padded[at + o]] @ net.kernel[o * byte_cnn.EMBEDDING:(o + 1) * byte_cnn.EMBEDDING, f])
                        for o in range(width))
            best[f] = max(best[f], value)
    return np.maximum(best + net.bias, 0) @ net.out + net.out_bias


def test_network_matches_loops():
    net = random_net()
    windows = byte_cnn.windows_of(("Übung macht den Meister. " * 12).encode())
    assert len(windows) == 2
    assert np.allclose(net.scores(windows), [plain_scores(net, w) for w in windows], rtol=1e-4, atol=1e-3)


@pytest.mark.parametrize("size", [1, 4, 255, 256, 257, 508, 509, 5000])
def test_windows_hold_every_byte_and_every_run(size):
    text = bytes(97 + i % 26 for i in range(size))
    windows = byte_cnn.windows_of(text)
    runs = {w[i:i + 5].tobytes() for w in windows for i in range(byte_cnn.WINDOW - 4)}
    assert {text[i:i + 5] for i in range(size - 4)} <= runs
    step = byte_cnn._STEP
    assert b"".join(w.tobytes()[: step if i + 1 < len(windows) else None] for i, w in enumerate(windows)).rstrip(b"\0") == text


def test_long_texts_in_bounded_batches_score_as_their_windows():
    net = random_net(1)
    texts = [b"short one", ("été à la plage " * 9000).encode(), b"x"]
    got = byte_cnn.text_scores(net, texts)
    for row, text in zip(got, texts, strict=True):
        w = byte_cnn.windows_of(text)
        size = (w != 0).sum(axis=1)
        want = (net.scores(w) * size[:, None]).sum(axis=0) / size.sum()
        assert np.allclose(row, want, rtol=1e-3, atol=1e-3)


def test_gradients_lower_the_loss():
    draw = np.random.default_rng(4)
    words = [[b"the ", b"and ", b"with "], [b"der ", b"und ", b"nicht "]]
    windows, labels = [], []
    for i in range(200):
        text = b"".join(draw.choice(words[i % 2], 60))
        windows.append(byte_cnn.windows_of(text)[0])
        labels.append(i % 2)
    net = byte_cnn.train(np.array(windows), np.array(labels), 2, epochs=2)
    shares = byte_cnn.softmax(net.scores(np.array(windows)))
    assert (shares.argmax(axis=1) == labels).mean() > 0.98


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES["op12_byte_cnn"](spark, SF)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    both = found.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(both) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in both)
    held = [r for r in both if r["held_out"] and r["lang_pred"] != "und"]
    right = np.array([r["lang_pred"] == r["lang"] for r in held])
    long = np.array([len(r["text"]) > 200 for r in held])
    assert right.mean() > 0.95 and right[long].mean() > 0.98, (right.mean(), right[long].mean())
    for lang in {r["lang"] for r in held}:
        own = np.array([r["lang"] == lang for r in held])
        assert right[own].mean() > 0.9, lang


def test_learns_from_the_rest_alone(spark, edge):
    """Held-out labels make no difference, and what is no language stays unknown."""
    rows = [(i, t, "en" if i % 2 else "xx") for i, t in enumerate(
        ["the cat and the dog"] * 20 + ["der Hund und nicht die Katze"] * 20 + ["123 456", "", None, "!!!", "é"])]
    docs = spark.createDataFrame([(i, t, g, 1.0, "p") for i, t, g in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    lied = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 1, F.lit("zz")).otherwise(F.col("lang")))
    out = F.col("doc_id") % 3 == 1
    one, two = (sorted(map(tuple, byte_cnn.language_id(d, out).collect())) for d in (docs, lied))
    assert one == two
    assert [r[2] for r in one[40:44]] == ["und"] * 4 and one[44][2] in ("en", "xx")
    assert all(r[3] == 0 for r in one[40:44])
    assert byte_cnn.language_id(edge, F.col("doc_id") == 6).count() == edge.count()


def test_no_labels_and_empty_tables(spark, edge, no_docs):
    assert byte_cnn.language_id(no_docs, F.lit(False)).count() == 0
    unknown = byte_cnn.language_id(edge.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}
