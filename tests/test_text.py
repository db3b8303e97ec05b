"""Lines, windows, headings and refinement against plain loops."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand import queries
from lodestrand.config import PIPELINE, STANDALONE, SUPPORTED_EXTENSIONS, Settings
from lodestrand.functions import ids
from lodestrand.functions import text as X
from lodestrand.functions import vectors as V
from lodestrand.operators import chunking
from tests.conftest import DATA

EDGES = ["", "\n", "a", "a\n", "a\r\nb", "a\r", "\r\n", "\n\n", "a\n\nb\n", " \n\t\n", "x\r\r\ny"]


def lines_of(text):
    """The rule, word by word."""
    out, rest = [], text
    while rest:
        line, mark, rest = rest.partition("\n")
        out.append(line[:-1] if mark and line.endswith("\r") else line)
    return out


def windows_of(parts, size, overlap):
    step, k, out = max(size - overlap, 1), 0, []
    while k < len(parts):
        end = min(k + size, len(parts))
        if "\n".join(parts[k:end]).strip():
            out.append((k + 1, end, "\n".join(parts[k:end])))
        if end >= len(parts):
            break
        k += step
    return out


def files(spark, texts, ending=".yml"):
    return spark.createDataFrame([(f"f{k}{ending}", t) for k, t in enumerate(texts)], "relative_path string, content string")


def test_lines(spark):
    df = files(spark, EDGES)
    got = {r.relative_path: r.l for r in df.select("relative_path", X.lines(F.col("content")).alias("l")).collect()}
    assert [got[f"f{k}.yml"] for k in range(len(EDGES))] == [lines_of(t) for t in EDGES]
    assert [chunking.split_lines(t) for t in EDGES] == [lines_of(t) for t in EDGES]


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    return ["\n".join(rnd.choice(["", " ", "word", "two words", "x" * 90, "# head", "#no", "é" * 30]) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "\n"]) for _ in range(n)]


def test_windows(spark):
    texts = EDGES + random_texts(40)
    for size, overlap in ((1, 0), (6, 0), (6, 2), (3, 3), (2, 5)):
        got = {}
        for r in chunking.line_chunks(files(spark, texts), size, overlap).collect():
            got.setdefault(r.relative_path, []).append((int(r.chunk_id.split(":")[-1]), r.start_line, r.end_line, r.content))
        want = {f"f{k}.yml": [(n, *w) for n, w in enumerate(windows_of(lines_of(t), size, overlap))] for k, t in enumerate(texts)}
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_markdown(spark):
    text = "# Title\nintro\n## A\none\ntwo\nthree\n\n### B\n#none\n"
    got = chunking.markdown_chunks(files(spark, [text, "\n\n# X\ny", "  \n "], ".md"), 3, 0).orderBy("relative_path", "start_line").collect()
    assert [(r.chunk_id, r.start_line, r.end_line, r.content) for r in got] == [
        ("f0.md:md:0", 1, 2, "# Title\nintro"),
        ("f0.md:md:1:0", 3, 5, "## A\none\ntwo"),
        ("f0.md:md:1:1", 6, 6, "three"),
        ("f0.md:md:2", 8, 9, "### B\n#none"),
        ("f1.md:md:0", 3, 4, "# X\ny"),
    ]
    assert {r.language for r in got} == {"markdown"}


def refine_loop(content, most, overlap):
    """Pieces line by line, as text grows."""
    parts, first, out = lines_of(content), 0, []
    while first < len(parts):
        text, end = "", first
        for k in range(first, len(parts)):
            more = parts[k] if not text else "\n" + parts[k]
            if text and len((text + more).encode()) > most:
                break
            text += more
            end = k + 1
            if len(text.encode()) >= most:
                break
        out.append((first, first + 1 if not text else end, text))
        if end >= len(parts):
            break
        first = end - overlap if end - overlap > first else end
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\r", max_size=120), st.integers(1, 40), st.integers(0, 4))
def test_packing_of_lines(text, most, overlap):
    got = [(a, a + 1 if not t else b, t) for a, b, t in chunking.pack_lines(text, most, overlap)]
    assert got == refine_loop(text, most, overlap)
    assert all(len(t.encode()) <= most or b - a == 1 or "\n" not in t for a, b, t in got)


def test_refine(spark):
    chunk = [("p", "abc\nabc\nabc\nabc\nabc\nabc", "", "f.rs", 10, 15, "rust"), ("q", "short", "", "f.rs", 1, 1, "rust"), ("r", "x" * 200, "", "f.rs", 1, 1, "rust")]
    got = chunking.refine(spark.createDataFrame(chunk, chunking.CHUNK), 12, 2).collect()
    own = [r for r in got if r.chunk_id.startswith("p")]
    assert [r.chunk_id for r in own] == [f"p_{k}" for k in range(len(own))]
    assert own[0].start_line == 10 and all(b.start_line <= a.end_line + 1 for a, b in zip(own, own[1:])) and own[-1].end_line == 15
    assert [(r.chunk_id, r.content) for r in got if r.chunk_id[0] != "p"] == [("q", "short"), ("r_0", "x" * 200)]


def test_split_dispatch(spark):
    rows = [("a.py", "def f():\n    return 1\n"), ("b.xyz", "text"), ("Makefile", "all:\n"), ("c.yml", "a: 1\n"), ("d.py", "X = 1\n"), ("e.md", ""), ("k.kt", "fun f() {}\n"), ("s.RST", "# a\nb")]
    got = chunking.split(spark.createDataFrame(rows, "relative_path string, content string"), STANDALONE).collect()
    assert {(r.relative_path, r.language) for r in got} == {("a.py", "python"), ("c.yml", "yaml"), ("k.kt", "kt"), ("s.RST", "markdown")}


def split_loop(path, text, most=512):
    """A file's chunks (id, content, start, end), for what no syntax splitter takes."""
    name = path.rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[1].lower() if "." in name else ""
    if not text or ext not in SUPPORTED_EXTENSIONS:
        return []
    lines, size = lines_of(text), most // 80
    if ext in ("md", "rst"):
        starts = [k for k, x in enumerate(lines) if k == 0 or re.match("#+ ", x)]
        found, n = [], 0
        for a, b in zip(starts, [*starts[1:], len(lines)]):
            content = "\n".join(lines[a:b])
            if content.strip():
                inner = lines_of(content)
                if len(inner) <= size:
                    found.append((f"{path}:md:{n}", content, a + 1, b))
                else:
                    found += [(f"{path}:md:{n}:{k}", t, a + s, min(a + e, b)) for k, (s, e, t) in enumerate(windows_of(inner, size, 0))]
                n += 1
    else:
        found = [(f"{path}:lines:{k}", t, s, e) for k, (s, e, t) in enumerate(windows_of(lines, size, 0))]
    out = []
    for chunk_id, content, start, end in found:
        if len(content.encode()) <= most:
            out.append((chunk_id, content, start, end))
        else:
            out += [(f"{chunk_id}_{k}", t, start + a, start + b - 1) for k, (a, b, t) in enumerate(refine_loop(content, most, 0))]
    return out


def test_split_files_equals_loop(spark):
    """The query over all documents: every file that is no source code, by loops."""
    got = [r for r in queries.split_files(spark, DATA).collect() if r.language not in ("python", "rust")]
    want = [x for r in queries.files(spark, DATA).collect() if not r.relative_path.lower().endswith((".py", ".rs")) for x in split_loop(r.relative_path, r.content)]
    assert sorted((r.chunk_id, r.content, r.start_line, r.end_line) for r in got) == sorted(want) and len(want) > 300
    assert {r.language for r in got} == {"markdown", "yaml", "json"}


def test_presets():
    assert (PIPELINE.max_chunk_bytes, PIPELINE.overlap_lines, PIPELINE.lines_per_chunk) == (512, 0, 6)
    assert Settings().split == PIPELINE
    env = Settings.from_environment({"CHUNK_SIZE": "1000", "CHUNK_OVERLAP": "160", "EMBEDDING_URL": ""})
    assert (env.split.max_chunk_bytes, env.split.overlap_lines, env.embedding_url) == (1000, 2, None)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ids(spark):
    import hashlib

    want = hashlib.sha256(b"a/b.py" + (300).to_bytes(4, "little") + "é".encode()).hexdigest()
    assert one(spark, ids.chunk_id(F.lit("a/b.py"), F.lit(300), F.lit("é"))) == want
    number = int.from_bytes(hashlib.sha256(b"k").digest()[:8], "big") & (1 << 63) - 1
    assert one(spark, ids.vector_id(F.lit("k"))) == number
    for path, head in (("/a/my-repo", "my_repo"), ("/a/9x", "_9x"), ("/", "collection"), ("/a/b/", "b"), ("/x/" + "y" * 300, "y" * 238), ("/a/é b", "__b")):
        assert one(spark, ids.collection_name(F.lit(path))) == f"{head}_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    assert one(spark, ids.hit_key(F.lit(""), F.lit("a"), F.lit(1), F.lit(2), F.lit("go"))) == "a:1:2:go"


def test_extension_filter(spark):
    paths = ["a.rs", "b.RS", "dir.d/noext", "Makefile", "x.tar.gz", "y.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    get = lambda wanted: [r.p for r in df.where(X.matches_extension(F.col("p"), wanted)).collect()]
    assert get([]) == paths and get(["rs"]) == ["a.rs", "b.RS"] and get(["..GZ", ".md"]) == ["x.tar.gz", "y.md"] and get(["makefile"]) == []


def test_vectors(spark):
    get = lambda f, a, b: one(spark, f(F.array(*map(F.lit, a)).cast("array<float>"), F.array(*map(F.lit, b)).cast("array<float>")))
    assert abs(get(V.cosine, [1.0, 2.0], [1.0, 2.0]) - 1) < 1e-6 and get(V.cosine, [1.0, 0.0], [0.0, 1.0]) == 0
    assert get(V.cosine, [], []) == 0 and get(V.cosine, [1.0], [1.0, 2.0]) == 0 and get(V.cosine, [0.0], [1.0]) == 0
    assert get(V.l2, [0.0, 3.0], [4.0, 0.0]) == 5 and get(V.l2, [1.0], [1.0, 2.0]) is None and get(V.inner_product, [1.0, 2.0], [3.0, 4.0]) == 11


def test_refinement_holds_few_pieces():
    """A batch's pieces leave in parts of a bounded size, and are those of a loop."""
    import pyarrow as pa

    from lodestrand.operators import chunking

    text = "\n".join(f"line {k} of many" for k in range(20_000))
    batch = pa.RecordBatch.from_pydict({"chunk_id": ["a", "b"], "content": [text, "x y\n" * 3000], "file_path": ["", ""], "relative_path": ["a.yml", "b.yml"], "start_line": pa.array([1, 5], pa.int32()), "end_line": pa.array([20_000, 3004], pa.int32()), "language": ["yaml", "yaml"]})
    parts = list(chunking._refined(batch, 64, 1, chunking.COLUMNS))
    assert len(parts) > 1 and max(p.num_rows for p in parts) <= chunking.PIECES_AT_ONCE
    got = [x for p in parts for x in p.column(1).to_pylist()]
    assert got == [x[2] for t in batch.column(1).to_pylist() for x in chunking.pack_lines(t, 64, 1)]
