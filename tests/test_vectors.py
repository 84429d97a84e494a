import numpy as np
import pytest
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import vectorizer, vectors


def test_normalize_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vectors.l2_normalized(F.col("a")), vectors.l2_normalized(F.col("b")), vectors.cosine(F.col("a"), F.col("a"))).first()
    assert r[0] == [0.6, 0.8] and r[1] == [0.0, 0.0] and r[2] == pytest.approx(1.0)


def test_pooling(spark):
    rng = np.random.default_rng(0)
    h, m = rng.normal(size=(5, 4)), np.array([1, 1, 0, 1, 0])
    mean = lambda w: (h * w[:, None]).sum(0) / w.sum() / np.linalg.norm((h * w[:, None]).sum(0) / w.sum())
    long = spark.createDataFrame([(7, v.tolist(), int(k)) for v, k in zip(h, m)], "id int, vec array<double>, mask int")
    assert vectors.mean_pooled(long).first()["vector"] == pytest.approx(mean(np.ones(5)))
    assert vectors.mean_pooled(long, mask="mask").first()["vector"] == pytest.approx(mean(m))
    row = spark.createDataFrame([(h.tolist(), m.tolist(), [0] * 5)], "h array<array<double>>, m array<int>, z array<int>")
    got = row.select(vectors.pooled(F.col("h")), vectors.pooled(F.col("h"), F.col("m")), vectors.pooled(F.col("h"), F.col("z"))).first()
    assert got[0] == pytest.approx(mean(np.ones(5))) and got[1] == pytest.approx(mean(m)) and got[2] == [0.0] * 4


def test_hash_vector(spark):
    df = spark.createDataFrame([(t,) for t in ("some text", "some text", "query: some text", " ", None, "ünï 😀")], "t string")
    v = [np.array(r[0]) for r in df.select(vectors.hash_vector(F.col("t"))).collect()]
    assert all(len(x) == 1024 for x in v) and (v[0] == v[1]).all() and not (v[0] == v[2]).all()
    assert [round(float(np.linalg.norm(x)), 6) for x in v] == [1, 1, 1, 0, 0, 1]


def test_texts(spark):
    r = spark.createDataFrame([("Hello wonderful\nWORLD", ["A", " ", "B"])], "t string, p array<string>").select(
        tx.subwords(F.col("t")).alias("s"), tx.subword_ids(F.col("t"), 12).alias("i"), tx.subword_ids(F.col("t"), 4).alias("short"), tx.with_context(F.col("t"), F.col("p")).alias("c"),
        tx.with_context(F.col("t"), F.array(F.lit(" "))).alias("n"), tx.e5_prefixed(F.col("t"), True).alias("q"), tx.full_path(F.col("p")).alias("path"),
    ).first()
    assert r["s"] == ["hello", "wond", "derf", "ful", "world"]
    ids, mask = r["i"]["input_ids"], r["i"]["attention_mask"]
    assert ids[0] == 101 and ids[6] == 102 and ids[7:] == [0] * 5 and mask == [1] * 7 + [0] * 5 and all(1000 <= x < 30000 for x in ids[1:6])
    assert len(r["short"]["input_ids"]) == 4 and 102 not in r["short"]["input_ids"]
    assert r["c"].startswith("A: B: Hello") and r["n"].startswith("Hello") and r["q"].startswith("query: ") and r["path"] == "A >   > B"


def test_model_file(tmp_path):
    for name, size in (("none.onnx", None), ("m.bin", 2 << 20), ("small.onnx", 10)):
        path = tmp_path / name
        if size:
            path.write_bytes(b"x" * size)
        with pytest.raises(ValueError):
            vectors.check_model(str(path))


# A model of one operator, written as protocol buffers by hand: hidden states are the ids as floats, one wide.


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _value_info(name, kind, dims):
    shape = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def _tiny_model():
    cast = _field(1, "input_ids") + _field(2, "f") + _field(4, "Cast") + _field(5, _field(1, "to") + _field(3, 1) + _field(20, 2))
    axes = _field(1, 1) + _field(2, 7) + _field(8, "axes") + _field(9, (2).to_bytes(8, "little"))
    lift = _field(1, "f") + _field(1, "axes") + _field(2, "last_hidden_state") + _field(4, "Unsqueeze")
    pad = _field(1, 300_000) + _field(2, 1) + _field(8, "pad") + _field(9, bytes(1_200_000))
    graph = _field(1, cast) + _field(1, lift) + _field(2, "g") + _field(5, axes) + _field(5, pad) + _field(11, _value_info("input_ids", 7, ["b", "s"])) + _field(12, _value_info("last_hidden_state", 1, ["b", "s", 1]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


@pytest.fixture(scope="module")
def model_files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("model")
    words = ["[PAD]"] + [f"[unused{i}]" for i in range(1, 100)] + ["[UNK]", "[CLS]", "[SEP]", "[MASK]", "query", "passage", ":", "some", "text", "##s"]
    (folder / "vocab.txt").write_text("\n".join(words))
    (folder / "tiny.onnx").write_bytes(_tiny_model())
    return str(folder / "tiny.onnx"), str(folder)


def test_wordpiece(model_files):
    ids, mask = vectorizer.wordpiece(model_files[1])(["Some texts", "text text text text"], 5)
    assert ids.tolist() == [[101, 107, 108, 109, 102], [101, 108, 108, 108, 102]] and mask.all()
    with pytest.raises(ValueError):
        vectorizer.wordpiece("/no/such/file")


def test_model_inference(spark, model_files):
    df = spark.createDataFrame([(1, "some text", 5), (2, " ", 6), (3, None, 7)], "i int, text string, vector int")
    made = vectorizer.Vectorizer.with_paths(*model_files, max_length=16).vectorize(df, is_query=True)
    rows = {r["i"]: (r["vector_source"], r["vector"]) for r in made.collect()}
    assert rows == {1: ("model", [1.0]), 2: ("blank", [0.0]), 3: ("blank", [0.0])}
    hidden = vectors.model_vectors(df.select("text"), model_files[0], vectorizer.wordpiece(model_files[1]), max_length=8, use_mask=False)
    assert hidden.count() == 3


def test_hashed(spark):
    df = spark.createDataFrame([(1, "some text"), (2, "")], "i int, text string")
    short = vectorizer.Vectorizer.short_text()
    rows = short.vectorize(df).orderBy("i").collect()
    assert short.max_length == 256 and vectorizer.Vectorizer.long_text().max_length == 1024
    assert [r["vector_source"] for r in rows] == ["hash", "blank"] and len(rows[0]["vector"]) == 1024
    query = vectorizer.Vectorizer.deterministic().vectorize(df, is_query=True).orderBy("i").first()["vector"]
    assert query != rows[0]["vector"]
    with pytest.raises(ValueError):
        vectorizer.Vectorizer(model_path="x.onnx")
    with pytest.raises(ValueError):
        vectorizer.Vectorizer.default("/no/such/folder")


def test_output_names():
    from foliate.operators.vectors import chosen_output

    assert chosen_output(["a", "LAST_hidden_state"]) == "LAST_hidden_state" and chosen_output(["logits", "Output", "x"]) == "Output"
    assert chosen_output(["x", "y"]) == "x" and chosen_output(["encoder_outputs", "hidden_states"]) == "hidden_states"
