from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SENTENCES = [
    "the quick brown fox jumps over the lazy dog and runs away into the dark forest behind the old mill.",
    "a small river flows past the village where nobody has lived since the last great flood came down.",
    "every morning the baker opens his shop and puts the fresh bread into the window for all to see.",
    "Die Straße führt über den Fluß, und hinter der Brücke beginnt schon das nächste größere Dorf.",
    "Le garçon a mangé déjà trois pommes, mais sa sœur préfère les poires du jardin de la voisine.",
]


def awkward() -> list[tuple]:
    """NULLs, empty and very long texts, ties, repeated rows, markup, symbols and odd white space."""
    texts = [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "word",
        "one two",
        "\n".join(SENTENCES),
        "\n".join(SENTENCES),
        "\n".join(SENTENCES[1:]),
        " ".join(SENTENCES) + " " + SENTENCES[0],
        SENTENCES[0] + "\n" + SENTENCES[0] + "\n\n" + SENTENCES[3],
        "Released under the MIT License.\n" + SENTENCES[2],
        "spam " * 400,
        "BUY!! NOW!! *** $$$ ### &&& %%% " * 30,
        "x" * 20_000,
        ("éß😀 \u3000\u00a0 日本語 ' 's 'll 123 !? \r\n" * 40),
        " ".join(f"w{i}" for i in range(5_000)),
        "a\0b\0c " * 30,
        "<|endoftext|> <p>&amp; | table | row |</p>",
    ]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else f"s{i}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5]]  # repeated rows
    rows += [(None, SENTENCES[1] * 3, "en", "s", 1), (None, None, None, None, None), (100, SENTENCES[1] * 3, "en", "s", 1)]
    return rows


@pytest.fixture(scope="session")
def edge_rows() -> list[tuple]:
    return awkward()


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge):
    """Extra columns with the names that operators use for their results."""
    from pyspark.sql import functions as F

    names = "ids decoded score fp fingerprint component component_id removed kept matches shard slot size path piece start length offset label bucket _q _words _grams"
    return edge.withColumns({n: F.lit("mine") for n in names.split()})


@pytest.fixture(scope="session")
def labelled(spark):
    """Documents of two plain kinds and their labels."""
    good = [(i, " ".join(SENTENCES[(i + k) % 5] for k in range(1 + i % 3)), "en", "s", 0) for i in range(0, 200, 2)]
    bad = [(i, "BUY!! " * (5 + i % 7) + "*** " + SENTENCES[i % 5].upper().replace(" ", "!! "), "en", "s", 0) for i in range(1, 200, 2)]
    docs = spark.createDataFrame(sorted(good + bad), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    return docs, labels


@pytest.fixture(scope="session")
def corpus(tmp_path_factory, spark, edge, labelled):
    """A folder of tables for whole queries."""
    folder = tmp_path_factory.mktemp("corpus")
    docs, labels = labelled
    docs.unionByName(edge.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars")).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def bare_corpus(tmp_path_factory, empty, labelled):
    folder = tmp_path_factory.mktemp("bare")
    empty.write.parquet(f"{folder}/documents.parquet")
    labelled[1].limit(0).write.parquet(f"{folder}/labels.parquet")
    return str(folder)
