import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators might use themselves
        *[T.StructField(name, T.StringType()) for name in ("digest", "row", "fp", "block", "shard", "kept", "gone", "key", "size")],
    ]
)
WORDS = "the of and to in a is that for it was on with as be by this ßtraße été niño 日本 THE Of x1 12 café".split()


@pytest.fixture(scope="session", autouse=True)
def stages(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stages")))


def random_texts(n, seed=0, lines=True):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(1, 60))]
        out.append("".join(w + (rng.choice(["\n", " ", " ", "  ", "\t"]) if lines else " ") for w in words))
    return out


@pytest.fixture(scope="session")
def hard_rows():
    """(doc_id, text) with nulls, empty and long texts, ties and repeated rows."""
    texts = random_texts(60)
    rows = list(enumerate(texts))
    rows += [(100 + i, "Same Text\nhere") for i in range(40)]  # a hot group
    rows += [(200, "SAME text\nhere"), (201, "same text\nhere "), (202, None), (203, ""), (204, "\n\n"), (205, "   \t")]
    rows += [(206, "word " * 30_000), (207, "x" * 100_000), (208, "1234 !!! 5"), (209, "日本語のテキスト"), (210, "Ａ b c")]
    rows += [(3, texts[3]), (3, texts[3]), (4, "another text under the same id"), (None, "no id"), (None, "no id"), (None, None), (None, texts[5])]
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, langs=None):
        filler = ("clash",) * (len(SCHEMA) - 5)
        data = [(i, t, langs[k] if langs else None, None, None, *filler) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, SCHEMA)

    return make
