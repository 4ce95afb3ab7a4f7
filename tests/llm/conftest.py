import random

import pytest
from brute import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_tables(spark, tmp_path_factory):
    """Tables with nulls in every column, empty and very long texts, repeated rows, ties and columns with clashing names."""
    rng = random.Random(4)
    base = [prose(rng, 60) for _ in range(30)]
    passage = prose(rng, 40)
    texts = [*base, base[0], base[0], base[1] + " end", None, None, "", "", " \t\n ", "x" * 30000, " ".join(["a"] * 9000), "a@b.c " * 3000, "1" * 5000, "\U0001f600 é ß ▁ \x00", prose(rng, 20) + " " + passage + " " + prose(rng, 20), prose(rng, 30000)]
    rows = [(i if i % 9 else i, t, ["en", "de", None][i % 3], ["s0", None][i % 2], None if t is None or i % 7 == 0 else len(t)) for i, t in enumerate(texts)]
    rows += [(None, base[2], None, None, None), (None, base[2], "en", "s0", 3), (None, "only without an id " + prose(rng, 30), "en", "s0", 3), rows[5], rows[5]]
    clash = "score double, id long, words string, key string, label int, fp string, _key string, component string"
    docs = spark.createDataFrame([(*r, 1.5, 7, "w", "k", 1, "f", "_", "c") for r in rows], f"{COLUMNS}, {clash}")
    labels = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(45)] + [(3, None, None), (None, 1, 1), (1, 0, 1), (1, 0, 1)]
    labels = spark.createDataFrame([(*r, "t", 2) for r in labels], "doc_id long, quality int, toxic int, text string, label int")
    bench = spark.createDataFrame([(0, passage, 1), (1, None, 1), (None, "", 1), (2, "short one", 1), (0, passage, 1)], "item_id long, text string, doc_id int")
    v = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    vectors = [*v, v[0], v[0], [x * 2.5 for x in v[1]], [0.0] * 16, [], None, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, v[2][:8]]
    emb = spark.createDataFrame([(i, e, 0, 1) for i, e in enumerate(vectors)] + [(None, v[3], 0, 1), (4, v[4], None, 1)], "vec_id long, embedding array<float>, label int, n int")
    full, empty = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("empty")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench), ("embeddings", emb)):
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty), rows, vectors
