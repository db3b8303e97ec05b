"""Every query over awkward rows, an empty table, and tables with clashing columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrand.llm import common, decontaminate, eliasfano, jaccard, language, linededup, ogg, packing, ppm, queries, tokencounts, urls
from tests.llm.test_operators import slow_sums
from tests.llm.conftest import corpus, left_out, same, texts, write

VOCABULARY = "/opt/tokenizers/"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == 0


def test_op1_against_brute_force(spark, odd):
    sets, want = {}, {}
    rows = texts()
    for _, t in rows:
        w = decontaminate.words(t.encode())
        # A text without words is like texts of the same bytes only.
        sets[t] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([t])
    copies = defaultdict(list)
    for i, t in rows:
        copies[sets[t]].append(i)
    classes = list(copies)
    links = {a: {b for b in classes if b is not a and len(a & b) / len(a | b) >= 0.8} for a in classes}
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    for i, t in rows:
        own = sets[t]
        group, todo = {own}, [own]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        want[i, t] = (least([x for s in group for x in copies[s]]), least(copies[own]), len(links[own]))
    got = Counter(tuple(r) for r in jaccard.op1_ngram_jaccard_join(spark, odd).select("doc_id", "class_id", "copy_id", "n_links").collect())
    assert got == Counter((i, *want[i, t]) for i, t in rows)
    assert max(n for _, _, n in want.values()) > 3


def test_op2_base_and_known(spark, odd):
    lower = lambda t: [*t.encode().translate(ppm._LOWER).split(), b" "]
    counts = Counter(w for i, t in texts() if not left_out(i, 10) for w in lower(t))
    n = sum(counts.values())
    want = []
    for i, t in texts():
        own = lower(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in own)
        want.append((-1 if i is None else i, left_out(i, 10), len(own), sum(counts[w] > 0 for w in own), n, round(base, 4)))
    got = ppm.op2_lm_scoring(spark, odd).collect()
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
    assert sorted(map(key, got)) == sorted(want) and all(r.score < 0 for r in got)


def test_op3_equals_sql(spark, odd, sql):
    same(decontaminate.op3_benchmark_decontamination(spark, odd), sql, decontaminate.ORACLE)


def test_op3_in_blocks(spark, odd, sql, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    same(decontaminate.op3_benchmark_decontamination(spark, odd), sql, decontaminate.ORACLE)


def test_op4_reads_back_the_library_ids(spark, odd):
    library = Tokenizer.from_file(VOCABULARY + eliasfano.TOKENIZER)
    start = 0
    rows = [(i, np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")) for i, t in texts()]
    got = sorted(eliasfano.op4_token_id_output(spark, odd).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -1, len(x), zlib.crc32(x.tobytes())) for i, x in rows)
    for r in got:
        assert r.start == start
        start += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)


def test_op4_special_strings_of_any_case(spark, tmp_path):
    """Ids, and the starts of the documents after them, where a special string has capitals."""
    library = Tokenizer.from_file(VOCABULARY + eliasfano.TOKENIZER)
    rows = [(1, "a <|ENDOFTEXT|> b"), (2, "x <|StartOfText|>"), (3, "after <|endoftext|>"), (4, "plain")]
    want, start = [], 0
    for i, t in rows:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = eliasfano.op4_token_id_output(spark, write(tmp_path, [(i, t, None, None, None) for i, t in rows], []))
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op5_pieces(spark, odd):
    library = Tokenizer.from_file(VOCABULARY + packing.TOKENIZER)
    coded = Counter()
    for i, t in texts():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        coded.update((i, a, n, zlib.crc32(ids[a : a + n].tobytes()), len(ids)) for a, n in packing.pieces(len(ids)))
    got = packing.op5_packing(spark, odd).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == coded
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & r.length - 1 == 0 and r.length <= 1024 for r in got)
    by_id = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert by_id == sorted(by_id)


def test_op6_counts(spark, odd):
    library = Tokenizer.from_file(VOCABULARY + tokencounts.TOKENIZER)
    want = Counter((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts())
    got = tokencounts.op6_token_counts(spark, odd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_op9_equals_sql(spark, odd, sql):
    # SQL compares a null id with none: such rows are held against the rule by hand.
    query = linededup.ORACLE.replace("k.doc_id <> r.last AS gone", "k.doc_id IS DISTINCT FROM r.last AS gone")
    same(linededup.op9_line_dedup(spark, odd), sql, query)
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.op9_line_dedup(spark, odd).collect()}
    assert all(got[1100 + k] == (3, 2) for k in range(6)) and got[1106] == (3, 0)


def test_op10_learns_and_leaves_out(spark, odd):
    got = language.op10_language_id(spark, odd).collect()
    by = {(r.doc_id, r.held_out): r for r in got if r.doc_id is not None and r.doc_id < 1000}
    langs = {r[0]: r[2] for r in corpus() if r[0] is not None and r[0] < 1000}
    held = [(r, langs[i]) for (i, h), r in by.items() if h]
    assert all(h == left_out(i, 5) for i, h in by) and sum(r.lang_pred == x for r, x in held) / len(held) > 0.9
    odd_rows = {r.doc_id: r for r in got}
    assert all(odd_rows[i].lang_pred == "und" and odd_rows[i].score == 0 for i in (1000, 1001, 1002, 1003)) and odd_rows[1004].lang_pred != "und"
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)


def test_op10_equals_slow_loop(spark, odd):
    """The query's rows against the network run byte by byte over whole texts."""
    net = language.fit(common.documents(spark, odd))
    got = {(r.doc_id, round(r.score, 2)): r.lang_pred for r in language.op10_language_id(spark, odd).collect()}
    done = 0
    for i, t in texts():
        if language.has_letter(t.encode()) and (len(t) < 1500 or i == 1006):
            sums = slow_sums(net, t.encode())
            near = {got.get((i, round(sums.max() / sums.sum() + d, 2))) for d in (-0.005, 0, 0.005)}
            assert net.languages[int(sums.argmax())] in near
            done += 1
    assert done > 50
    null = [r for r in language.op10_language_id(spark, odd).collect() if r.doc_id is None]
    assert [r.held_out for r in null] == [False]


def test_op2_scores_equal_a_dictionary(spark, odd):
    """The query's score of short and odd texts against counts in a dictionary and a loop over symbols."""
    lower = lambda t: t.encode().translate(ppm._LOWER)
    follow: dict[bytes, Counter] = defaultdict(Counter)
    steps = lambda t: [(bytes(ppm.ORDER) + t)[k : k + ppm.ORDER] for k in range(len(t) + 1)]
    for i, t in texts():
        if not left_out(i, 10):
            raw = lower(t)
            for context, symbol in zip(steps(raw), [*raw, ppm.END], strict=True):
                for n in range(ppm.ORDER + 1):
                    follow[context[n:]][symbol] += 1

    def chance(context, symbol):
        p, out = 1.0, set()
        for n in range(ppm.ORDER + 1):
            own = {s: c for s, c in follow[context[n:]].items() if s not in out}
            if own:
                total = 2 * sum(own.values())
                if symbol in own:
                    return p * (2 * own[symbol] - 1) / total
                p *= len(own) / total
                out |= set(own)
        return p / (ppm.SYMBOLS - len(out))

    got = defaultdict(set)
    for r in ppm.op2_lm_scoring(spark, odd).collect():
        got[r.doc_id].add(round(r.score, 4))
    done = 0
    for i, t in texts():
        raw = lower(t)
        if len(raw) < 700:
            want = sum(math.log10(chance(c, s)) for c, s in zip(steps(raw), [*raw, ppm.END], strict=True))
            assert min(abs(want - x) for x in got[i]) < 1e-3
            done += 1
    assert done > 25


def test_op8_columns_of_every_row(spark, odd):
    """What is read back against the texts' own bytes, by hashlib and zlib."""
    docs = common.documents(spark, odd).select("doc_id", "text")
    media = {bytes(r.media) for r in ogg.encode_column(docs, "text").collect()}
    sizes = {hashlib.sha256(x).hexdigest(): len(x) for x in media}
    want = Counter()
    for i, t in texts():
        payload = t.encode() + bytes(64 - len(t.encode()) % 64 if len(t.encode()) % 64 or not t else 0)
        want[i, len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    rows = ogg.op8_ogg_media(spark, odd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert all(sizes[r.media_sha256] == r.media_bytes for r in rows)


def test_op7_with_edges(spark, tmp_path):
    """Chains, hubs, odd and very long pages: the query against its SQL."""
    pages = [(k, f"http://a{k}.net/p", f'<link rel="canonical" href="http://a{k + 1}.net/p">') for k in range(40)]
    pages += [(100 + k, f"http://leaf{k}.net/", '<meta http-equiv="refresh" content="0; url=http://hub.com/de/">') for k in range(60)]
    pages += [(200, "http://a40.net/p", '<link rel="canonical" href="http://x.example.org/es/">'), (201, "http://hub.com/de/", None), (None, None, None), (203, "http://long.net/" + "q" * 50_000, "x" * 300_000 + '<link rel=canonical href="http://hub.com/de/">')]
    folder = write(tmp_path, [], [], pages=pages)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    got = urls.op7_url_filter(spark, folder)
    want = con.sql(urls.ORACLE).select("page_id, host, path, rule, verdict").fetchall()
    rows = got.select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, rows)) == Counter(want)
    assert all(r.verdict == "block" for r in rows if r.page_id is not None)


def test_op3_items_without_an_id(spark, tmp_path):
    """Their windows are hits and contaminate; they are not counted or listed."""
    text = "one two three four five six seven eight nine ten"
    folder = write(tmp_path, [(1, f"x {text} y", None, None, None), (2, "one two", None, None, None), (3, f"{text} and solo", None, None, None)], [(None, text), (None, None), (7, "solo")])
    found = {r.doc_id: r for r in decontaminate.op3_benchmark_decontamination(spark, folder).collect()}
    assert [(found[k].n_hit, found[k].n_items, found[k].contaminated) for k in (1, 2, 3)] == [(10, 0, True), (0, 0, False), (11, 1, True)]
    assert found[1].items_sha256 == hashlib.sha256(b"").hexdigest() and found[3].items_sha256 == hashlib.sha256(b"7").hexdigest()
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    same(decontaminate.op3_benchmark_decontamination(spark, folder), con, decontaminate.ORACLE)
    kept = decontaminate.decontaminated(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert [r.doc_id for r in kept.collect()] == [2]


def test_op6_refuses_other_rules():
    import public_tokenizers

    assert len(tokencounts.whole_tokens(public_tokenizers.path("byte_bpe_50k.json"))) > 40_000
    with pytest.raises(ValueError, match="word_bpe_49k"):
        tokencounts.whole_tokens(public_tokenizers.path("word_bpe_49k.json"))


def test_op1_refuses_what_its_trees_cannot_find(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    with pytest.raises(ValueError, match="similarity 0.1"):
        jaccard.JaccardJoin(docs, threshold=0.1)
    jaccard.JaccardJoin(docs, threshold=0.4)


def test_op7_large_components_and_null_urls(spark):
    """One component of 5,000 nodes, a popular url and many nulls: right verdicts, and no partition with most of the rows."""
    hub = "http://block.example.org/es/0"
    rows = [(k, f"http://h{k}.net/p", f'<link rel="canonical" href="{"http://example.org/es/0" if k == 1 else "http://h1.net/p"}">') for k in range(1, 5001)]
    rows += [(10_000 + k, None, None) for k in range(3000)] + [(20_000 + k, "http://h7.net/p", None) for k in range(3000)] + [(30_000, hub, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    kept = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        judged = urls.judge(pages).withColumn("part", F.spark_partition_id()).cache()
        sizes = [r["count"] for r in judged.groupBy("part").count().collect()]
        found = {(r.verdict, r["count"]) for r in judged.groupBy("verdict").count().collect()}
        judged.unpersist()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    # All of h1 .. h5000 are aliases of a blocked url, popular h7 too; the page under the blocked path's host has a subdomain of it.
    assert found == {("block", 8001), ("allow", 3000)}
    assert max(sizes) <= sum(sizes) / 4
