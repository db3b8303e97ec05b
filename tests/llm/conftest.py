"""A small corpus with every awkward case, as the driver's tables."""

from __future__ import annotations

import random
import zlib

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.conftest import DATA

FOOTER = "This line of the footer is long enough to be dropped where it repeats"


def awkward() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(120)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 120, 12)]
    return [
        (1000, None),
        (1001, ""),
        (1002, " \n\t "),
        (1003, "12 34 !!"),
        (1004, "a"),
        (1005, "x" * 70_000),
        (1006, "word " * 20_000),
        (1007, "tie tie tie"),
        (1007, "tie tie tie"),
        (1007, "another text of the same id"),
        (1008, "ünï <|endoftext|> 日本語 \x00 'S don't  two\n\n  spaces"),
        (1009, "no line end at all\r\nbut returns\r"),
        (None, "a row without an id, of some words that no other row has"),
        *((1100 + k, f"{FOOTER}\nown {k}\n  {FOOTER.upper()} ") for k in range(7)),
        *((1200 + k, x) for k, x in enumerate(near)),
        *((1300 + k, near[0]) for k in range(5)),
    ]


def write(folder, rows, items, pages=(), extra=False):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    table = pa.table([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=names)
    if extra:
        for name in ("score", "n_words", "spans", "items", "SET", "block", "lost", "row", "lang_pred", "found_score", "held_out", "key", "hits_spans", "media"):
            table = table.append_column(name, pa.array([7] * len(table), pa.int32()))
    pq.write_table(table, folder / "documents.parquet")
    pq.write_table(pa.table([pa.array([i for i, _ in items], pa.int64()), pa.array([t for _, t in items], pa.string())], names=["item_id", "text"]), folder / "benchmark.parquet")
    columns = list(zip(*pages)) if pages else [[]] * 3
    pq.write_table(pa.table([pa.array(list(x), k) for x, k in zip(columns, [pa.int64(), pa.string(), pa.string()])], names=["page_id", "url", "html"]), folder / "pages.parquet")
    # The tables of the other queries, without rows.
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    pq.write_table(pa.table({"sale_id": pa.array([], pa.int64()), "total": pa.array([], pa.float64()), "sold_at": pa.array([], pa.timestamp("us"))}), folder / "sales.parquet")
    return str(folder)


def corpus() -> list[tuple]:
    rows = [tuple(r.values()) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    return rows + [(i, t, None if k % 3 else "en", "odd", None) for k, (i, t) in enumerate(awkward())]


def benchmark() -> list[tuple]:
    items = [tuple(r.values()) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    return [*items, (900, "tie tie"), (901, None), (902, ""), (903, "TIE, tie"), (None, "a row without"), (904, "word " * 12)]


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """The corpus, its items, and extra columns whose names the operators use themselves."""
    return write(tmp_path_factory.mktemp("odd"), corpus(), benchmark(), extra=True)


@pytest.fixture(scope="session")
def nothing(tmp_path_factory):
    return write(tmp_path_factory.mktemp("nothing"), [], [])


@pytest.fixture(scope="session")
def sql(odd):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{odd}/{name}.parquet'")
    return con


def same(df, con, query):
    got, want = df.toPandas(), con.sql(query).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    def rows(frame):
        values = frame[names].astype(object)
        return sorted(tuple("" if pd.isna(v) else str(int(v) if isinstance(v, float) else v) for v in r) for r in values.itertuples(index=False))

    assert rows(got) == rows(want)


def texts() -> list[tuple[int | None, str]]:
    return [(r[0], r[1] or "") for r in corpus()]


def left_out(doc_id, parts):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == 0
