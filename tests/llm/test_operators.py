"""The operators' own parts against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm import common, components, decontaminate, eliasfano, jaccard, language, linededup, ogg, packing, ppm, tokencounts, tokens, urls
from lodestrand.llm.common import documents

TOKENIZERS = "/opt/tokenizers/"


# 1


@given(st.lists(st.frozensets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=12))
@settings(max_examples=60, deadline=None)
def test_similarities(sets):
    got = jaccard.similarities([np.array(sorted(x), np.uint64) for x in sets])
    assert all(abs(got[i, k] - len(a & b) / len(a | b)) < 1e-6 for i, a in enumerate(sets) for k, b in enumerate(sets) if i != k)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.95])
def test_prefixes_shorten_until_the_recall(threshold):
    """Whatever the nodes' sizes, the lengths reach the target; large nodes are left at longer prefixes."""
    rnd = random.Random(6)
    least, most = jaccard.depth_range(threshold)
    for _ in range(30):
        hot = rnd.sample(range(jaccard.TREES), rnd.randint(0, jaccard.TREES))
        sizes = {(t, d): rnd.choice([2, 5000, 10**9]) for t in hot for d in range(least, most + 1)}
        depths = jaccard.shortened(sizes, threshold)
        assert jaccard.recall(depths, threshold) >= jaccard.TARGET - 1e-12 and all(least <= d <= most for d in depths)
    small = {(t, d): 3 for t in (1, 7) for d in range(1, most + 1)}
    assert jaccard.shortened(small, threshold) == jaccard.shortened({}, threshold)
    if threshold == 0.8:
        large = jaccard.shortened({(0, d): 10**6 for d in range(1, most + 1)}, threshold)
        assert large[0] == most and sum(large[1:]) < sum(jaccard.shortened({}, threshold)[1:])


def similar_pairs(rows, threshold):
    sets = [set(jaccard.shingles(t.encode()).tolist()) for t in rows]
    return {(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8])
def test_pairs_near_the_threshold(spark, threshold):
    """Pairs little above the threshold are found, at thresholds other than the usual one too."""
    rnd, rows = random.Random(31), []
    # k changed words far apart take 5 k of n shingles: (n - 5 k) / (n + 5 k) similar.
    k = round(200 * (1 - threshold) / (1 + threshold) / 5) - 1
    for _ in range(60):
        base = [f"q{rnd.randint(0, 99999)}" for _ in range(204)]
        other = list(base)
        for place in range(k):
            other[7 + 6 * place] = f"z{rnd.randint(0, 99999)}"
        rows += [" ".join(base), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(max(r.id_a, r.id_b), min(r.id_a, r.id_b)) for r in jaccard.JaccardJoin(df, threshold=threshold).pairs().collect()}
    want = similar_pairs(rows, threshold)
    assert len(want) >= 60 and got <= want and len(got) >= 0.98 * len(want)


def near_group(n, seed=2, most=8):
    rnd = random.Random(seed)
    base = [f"v{rnd.randint(0, 9999)}" for _ in range(200)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in rnd.sample(range(200), rnd.randint(0, most)):
            own[k] = f"u{rnd.randint(0, 99999)}"
        out.append(" ".join(own))
    return out


def test_large_groups_in_blocks(spark, monkeypatch):
    """A group of many near copies is cut into blocks and loses no link."""
    monkeypatch.setattr(jaccard, "NODE_BLOCK", 8)
    monkeypatch.setattr(jaccard, "SMALL_NODE", 8)
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    rows = list(dict.fromkeys(near_group(45)))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = similar_pairs(rows, 0.8)
    join = jaccard.JaccardJoin(df)
    got = {(max(r.id_a, r.id_b), min(r.id_a, r.id_b)) for r in join.pairs().collect()}
    assert got == want and len(want) > 100
    links = Counter(x for pair in want for x in pair)
    assert {r.id: r.n_links for r in join.documents().collect()} == {k: links[k] for k in range(len(rows))}


def test_large_group_keeps_its_links(spark):
    """A group of thousands of copies and near copies, at the usual sizes of blocks."""
    rows = list(dict.fromkeys(near_group(3000, most=3)))
    df = spark.createDataFrame([*enumerate(rows), *((10_000 + k, rows[0]) for k in range(3000))], "doc_id long, text string")
    sets = [jaccard.shingles(t.encode()) for t in rows]
    similar = jaccard.similarities(sets) >= 0.8 - 1e-7
    np.fill_diagonal(similar, False)
    links = similar.sum(1)
    got = {r.id: (r.class_id, r.copy_id, r.n_links) for r in jaccard.JaccardJoin(df).documents().collect()}
    assert len(rows) > 2000 and links.mean() > 1000
    assert sum(got[k][2] for k in range(len(rows))) >= 0.999 * links.sum() and all(got[k][2] <= links[k] for k in range(len(rows)))
    assert {x[0] for x in got.values()} == {0} and all(got[10_000 + k] == got[0] for k in range(3000))


def test_id_filter(spark):
    """It has all its ids, nulls too, and nearly none of the others."""
    ids = spark.range(0, 5000, 5).select("id").union(spark.sql("SELECT cast(null AS long)"))
    other = spark.range(5000).union(spark.sql("SELECT cast(null AS long)"))
    held, rest = ({r.id for r in x.collect()} for x in common.IdFilter(ids, "id").split(other, "id"))
    assert {*range(0, 5000, 5), None} <= held and len(held) < 1010 and held | rest == {None, *range(5000)} and not held & rest
    assert common.IdFilter(ids.limit(0), "id").split(other, "id")[0].count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    left = spark.createDataFrame([(k % 7 if k % 7 < 6 else None, k) for k in range(60)], "key long, own long")
    right = spark.createDataFrame([(k, k * k, 10 - k) for k in range(5)], "key long, other long, weight long")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, common.hot_join(left, right, "key", "weight", how).collect())) == sorted(map(key, left.join(right, "key", how).collect()))


@pytest.mark.parametrize("held", [1, 7, 100_000])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD_EDGES", held)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    rnd = random.Random(9)
    edges = [(f"n{rnd.randint(0, 150):03}", f"n{rnd.randint(0, 150):03}") for _ in range(110)] + [(f"hub{0:03}", f"leaf{k:03}") for k in range(60)] + [(f"p{k:03}", f"p{k + 1:03}") for k in range(70)]
    above = {x: x for e in edges for x in e}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        above[max(top(a), top(b))] = min(top(a), top(b))
    df = spark.createDataFrame([*edges, (None, "n000"), ("n001", None)], "a string, b string")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {x: top(x) for x in above}
    assert components.connected_components(df.limit(0)).count() == 0


# 2


@pytest.mark.parametrize("run", [1, 3, 1 << 20])
def test_contexts_and_scores(monkeypatch, run):
    """The trie's scores against a dictionary and a loop."""
    train = [b"abracadabra", b"abc", b"", b"\xc3\xa9t\xc3\xa9"]
    test = [b"abracadz", b"", b"\xff\x00q"]
    follow: dict[bytes, Counter] = defaultdict(Counter)
    steps = lambda t: [(bytes(ppm.ORDER) + t)[k : k + ppm.ORDER] for k in range(len(t) + 1)]
    for t in train:
        for context, symbol in zip(steps(t), [*t, ppm.END], strict=True):
            for n in range(ppm.ORDER + 1):
                follow[context[ppm.ORDER - n :]][symbol] += 1

    def slow(context, symbol):
        p, out = 1.0, set()
        for n in range(ppm.ORDER, -1, -1):
            own = {s: c for s, c in follow[context[ppm.ORDER - n :]].items() if s not in out}
            if own:
                total = 2 * sum(own.values())
                if symbol in own:
                    return p * (2 * own[symbol] - 1) / total
                p *= len(own) / total
                out |= set(own)
        return p / (ppm.SYMBOLS - len(out))

    monkeypatch.setattr(ppm, "RUN_BYTES", run)
    codes, counts = ppm.counted(np.concatenate([c for c, _, _ in ppm.contexts(train)]))
    need = np.concatenate([c for c, _, _ in ppm.contexts(test)])
    every, sums = ppm.counted(np.concatenate([codes, need]), np.concatenate([counts, np.zeros(len(need), counts.dtype)]))
    short = ppm.ShortContexts(*ppm.counted(every & np.uint64((1 << 25) - 1), sums.astype(float)))
    monkeypatch.setattr(ppm, "CONTEXTS", 3)
    score: dict[int, float] = {}
    shards = sorted({int(c) >> 9 & 0xFFFFFF for c in every})
    for some in (shards[::2], shards[1::2]):
        own = np.array([int(c) >> 9 & 0xFFFFFF in some for c in every])
        score |= dict(zip(every[own].tolist(), ppm.shard_scores(every[own], sums[own].astype(float), short), strict=True))
    table = ppm.Lookup(np.array(list(score), np.uint64), np.array(list(score.values())))
    got = [0.0] * len(test)
    for codes, starts, owners in ppm.contexts(test):
        for part, owner in zip(np.split(codes, starts[1:]), owners, strict=True):
            got[owner] += table.get(part).sum()
    want = [sum(math.log10(slow(c, s)) for c, s in zip(steps(t), [*t, ppm.END], strict=True)) for t in test]
    assert np.allclose(got, want)


def test_chances_sum_to_one():
    rng = np.random.default_rng(0)
    levels = [rng.integers(0, 3, (6, ppm.SYMBOLS)) * (rng.random((6, ppm.SYMBOLS)) < 0.02), rng.integers(0, 5, ppm.SYMBOLS) * (rng.random(ppm.SYMBOLS) < 0.1)]
    assert np.allclose(ppm.chances(levels).sum(1), 1)


def test_scores_do_not_depend_on_blocks(spark):
    rows = [(k, t) for k, t in enumerate(near_group(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    a, b = ({r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in ppm.score_documents(df, block_bytes=n).collect()} for n in (1, 1 << 30))
    assert a == b and len(a) == 40


# 3


@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=6), min_size=1, max_size=8), st.text(alphabet="ab", max_size=60))
@settings(max_examples=200, deadline=None)
def test_wu_manber(patterns, text):
    own = sorted({p.encode() for p in patterns})
    found = []
    decontaminate.WuManber(own).find(text.encode(), found)
    want = sorted((k, p) for p in own for k in range(len(text)) if text.encode().startswith(p, k))
    assert sorted(found) == want


def test_clean_documents_stay(spark, odd):
    docs = documents(spark, odd)
    items = spark.read.parquet(f"{odd}/benchmark.parquet")
    kept = decontaminate.decontaminated(docs, items)
    clean = decontaminate.op3_benchmark_decontamination(spark, odd).where("not contaminated")
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in clean.collect())


# 4


@given(st.lists(st.integers(0, 10**9), max_size=300), st.integers(0, 40))
@settings(max_examples=100, deadline=None)
def test_elias_fano(values, shift):
    values = sorted(v >> shift for v in values)
    coded = eliasfano.EliasFano.of(np.array(values, np.uint64))
    again, end = eliasfano.EliasFano.read(memoryview(coded.tobytes()), 0)
    assert again.all().tolist() == values and [again.select(i) for i in range(len(values))] == values and end == len(coded.tobytes())


def test_id_file():
    raw = eliasfano.file_bytes([None, -5, 7, 7, 900], [1, 3, 0, 2, 1], np.arange(7, dtype="<u2").tobytes(), 2)
    file = eliasfano.IdFile(raw)
    assert file.doc_ids() == [None, -5, 7, 7, 900] == [file.doc_id(i) for i in range(5)]
    assert [file.ids(i).tolist() for i in range(5)] == [[0], [1, 2, 3], [], [4, 5], [6]] and [file.start(i) for i in range(6)] == [0, 1, 4, 4, 6, 7]
    with pytest.raises(ValueError, match="not a token-id file"):
        eliasfano.IdFile(b"x" * 99)
    bound = eliasfano.EliasFano.of(np.arange(0, 10**6, 100))
    assert len(bound.tobytes()) * 8 / bound.n < 10.5


def test_digests_select_each_boundary(monkeypatch):
    """Documents read back by select alone, over several batches, with empty ones among them."""
    rnd = random.Random(3)
    lengths = [rnd.choice([0, 1, 5, 300]) for _ in range(2 * eliasfano.common.BATCH_ROWS + 7)]
    ids = np.array([rnd.randint(0, 60_000) for _ in range(sum(lengths))], "<u2")
    names = [None, None, *range(-3, len(lengths) - 5)]
    file = eliasfano.IdFile(eliasfano.file_bytes(names, lengths, ids.tobytes(), 2))
    monkeypatch.setattr(file.bounds, "all", None)
    got = [tuple(r.values()) for b in eliasfano.digests(file, 1 << 33) for r in b.to_pylist()]
    ends = np.cumsum(lengths).tolist()
    assert got == [(i, (1 << 33) + e - n, n, zlib.crc32(ids[e - n : e].astype("<u4").tobytes())) for i, e, n in zip(names, ends, lengths, strict=True)]


# 5 and 6


@given(st.integers(0, 5000))
def test_pieces(n):
    got = packing.pieces(n)
    assert sum(size for _, size in got) == n and [a for a, _ in got] == [sum(s for _, s in got[:k]) for k in range(len(got))]
    assert all(s & s - 1 == 0 and s <= 1024 for _, s in got) and len(got) <= n // 1024 + 10


def test_buckets_hold_one_length(spark, odd, tmp_path):
    packed = packing.pack(documents(spark, odd), TOKENIZERS + packing.TOKENIZER)
    packing.write_buckets(packed, str(tmp_path / "b"))
    for folder in (tmp_path / "b").glob("length=*"):
        rows = spark.read.parquet(str(folder)).collect()
        assert {len(r.ids) // 2 for r in rows} == {int(folder.name.split("=")[1])}


ALPHABET = " \n\t'sSreabcÀéß.,!?12½İǅ\r\x1c\x85\xa0日"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("memo", [0, 5, 100_000])
def test_chunked_ids_are_the_library_ids(name, memo):
    rnd = random.Random(4)
    rows = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["x<|endoftext|> y", "<|startoftext|>", "a b", "  a", "a "]
    coder = tokens.Chunked(TOKENIZERS + name, name.startswith("word"), "<u2", memo)
    want = [np.array(x.ids, "<u2").tobytes() for x in coder.library.encode_batch(rows, add_special_tokens=False)]
    assert coder.encode(rows[:700]) + coder.encode(rows[700:]) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("memo", [0, 20, 100_000])
def test_words_signs_and_lines_are_cut_as_the_library_cuts(name, memo):
    rnd = random.Random(5)
    parts = ["word", "Été", "don't", "x's", "'s", "'", "...", "$$$", "_", "a_b", "3", "½", "ǅ", "日", "ª", "\n", "\n", " ", " ", " ", ",", "\u1c89", "́", "×"]
    rows = ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(3000)] + ["end.\nNext, ", "end.\n", "\nA.", "a.\nb.\nc."]
    coder = tokens.Chunked(TOKENIZERS + name, name.startswith("word"), "<u2", memo)
    want = [np.array(x.ids, "<u2").tobytes() for x in coder.library.encode_batch(rows, add_special_tokens=False)]
    assert coder.encode(rows[:1500]) + coder.encode(rows[1500:]) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_strings_of_any_case(name):
    rows = ["a <|ENDOFTEXT|> b", "x<|EndOfText|>y", "<|startOfText|>", "a <|endoftext|> B <|ENDOFTEXT|>", "plain A"]
    coder = tokens.Chunked(TOKENIZERS + name, name.startswith("word"), "<u2")
    assert coder.encode(rows) == [np.array(x.ids, "<u2").tobytes() for x in coder.library.encode_batch(rows, add_special_tokens=False)]


def test_whole_tokens_and_counts():
    path = TOKENIZERS + tokencounts.TOKENIZER
    proven = tokencounts.whole_tokens(path)
    assert len(proven) > 40_000 and " the" in proven
    rnd = random.Random(8)
    rows = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["x<|endoftext|> y", "unbelievably internationalised"]
    for memo in (0, 100_000):
        counter = tokencounts.Counter(path, proven, memo)
        assert counter.count(rows) == [len(x.ids) for x in counter.library.encode_batch(rows, add_special_tokens=False)]


# 7

PAGES = [
    (1, "http://a.net/x", '<link rel="canonical" href="http://B.example.org/es/1#f">'),
    (2, "https://b.net/y", '<meta http-equiv="refresh" content="0; url=/z">'),
    (3, "http://b.net/z", "<LINK href='//v.com/de/q' rel='canonical'>"),
    (4, "http://c.org/q", '<link rel="canonical" href="http://a.net/x">'),
    (5, "http://x.example.org/es/", ""),
    (6, None, None),
    (7, "nope", "<link rel=canonical href=/a>"),
    (8, "http://d.net/de/", '<link rel="canonical" href="rel.html">'),
    (9, "http://d.net/de/rel.html", None),
    (10, "http://u.COM/de/?x#y", None),
    (11, "http://org", ""),
    (12, "http://p.net?q=1", '<link rel=canonical href="?q=2">'),
    (13, "ftp://p.net/?q=2#z", '<meta content="3;URL=http://www.v.com/de/" http-equiv=refresh>'),
    (13, "ftp://p.net/?q=2#z", '<meta content="3;URL=http://www.v.com/de/" http-equiv=refresh>'),
    (14, "http://k.example.org/en/100", None),
    (15, "http://m.com/fr/de/", None),
]


def test_urls(spark):
    df = spark.createDataFrame([(*p, 1, 2) for p in PAGES], "page_id long, url string, html string, host int, verdict int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {
        1: ("a.net", "/x", None, "allow"),  # an alias of 4, which is explicitly allowed, and of a blocked url
        2: ("b.net", "/y", None, "block"),  # by way of 3
        3: ("b.net", "/z", None, "block"),
        4: ("c.org", "/q", "org/", "allow"),
        5: ("x.example.org", "/es/", "example.org/es/", "block"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("d.net", "/de/", None, "allow"),
        9: ("d.net", "/de/rel.html", None, "allow"),
        10: ("u.com", "/de/", "com/de/", "block"),
        11: ("org", "", None, "allow"),
        12: ("p.net", "", None, "block"),
        13: ("p.net", "/", None, "block"),
        14: ("k.example.org", "/en/100", "example.org/en/1", "block"),
        15: ("m.com", "/fr/de/", "com/fr/", "allow"),
    }
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert Counter(con.sql(urls.ORACLE).select("page_id, host, path, rule, verdict").fetchall()) == Counter((p[0], *got[p[0]]) for p in PAGES)
    redirects = spark.createDataFrame([("http://d.net/de/rel.html", "http://v.com/de/"), (None, "http://x.org/")], "a string, b string")
    more = {r.page_id: r.verdict for r in urls.judge(df, redirects=redirects).collect()}
    assert more[8] == more[9] == "block" and urls.judge(df, html=None).where("page_id = 2").first().verdict == "allow"


# 8


def slow_crc(raw):
    out = 0
    for byte in raw:
        out ^= byte << 24
        for _ in range(8):
            out = (out << 1 ^ 0x04C11DB7 if out & 0x80000000 else out << 1) & 0xFFFFFFFF
    return out


@given(st.binary(max_size=200))
def test_crc(raw):
    assert ogg.crc(raw) == slow_crc(raw)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 4095, 4096, 255 * 255, 70_000, 300_000])
def test_round_trip(size):
    raw = random.Random(size).randbytes(size)
    payload = ogg.padded(raw)
    assert len(payload) % 64 == 0 and payload.startswith(raw) and len(payload) > 0
    media = ogg.demux(ogg.mux(payload))
    assert ogg.payload_of(media) == payload and media.n_bad == 0 and all(x.ended for x in media.streams.values())
    for stream in media.streams.values():
        sizes = [0, *(len(p) for p in stream.packets[1:])]
        assert stream.granules == [sum(sizes[: k + 1]) for k in range(len(sizes))]


def test_long_packets_and_damage():
    packets = [(b"head", 0), (bytes(300_000), 300_000), (b"", 300_000), (b"x" * 510, 300_510)]
    pages = ogg.pages(packets, 5)
    media = ogg.demux(b"junk OggS" + b"".join(pages))
    assert media.streams[5].packets == [p for p, _ in packets] and media.streams[5].granules == [0, 300_000, 300_000, 300_510]
    broken = bytearray(b"".join(pages))
    broken[len(pages[0]) + 500] ^= 1
    hurt = ogg.demux(bytes(broken))
    assert hurt.n_bad >= 1 and hurt.n_pages == len(pages) - 1 and bytes(300_000) not in hurt.streams[5].packets
    assert ogg.demux(b"").streams == {} and ogg.demux(b"OggS").n_pages == 0


def test_media_columns(spark, odd):
    docs = documents(spark, odd).select("doc_id", "text")
    read = ogg.decode_column(ogg.encode_column(docs, "text"), "media").collect()
    assert all(r.n_bad_pages == 0 and len(r.streams) == 2 and all(s.ended for s in r.streams) for r in read) and len(read) == docs.count()
    rows = ogg.op8_ogg_media(spark, odd).collect()
    texts = {}
    for r in rows:
        assert texts.setdefault(r.payload_sha256, r.media_sha256) == r.media_sha256
    empty = next(r for r in rows if r.doc_id == 1000)
    assert (empty.n_bytes, empty.payload_bytes, empty.tail_crc32) == (0, 64, zlib.crc32(bytes(64)))


# 10


def test_gradients():
    rng = np.random.default_rng(0)
    net = language.Network.start(["a", "b", "c"], hidden=5)
    for name in ("tables", "recurrent", "inner"):
        setattr(net, name, [x.astype(np.float64) for x in getattr(net, name)])
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    steps, labels = rng.integers(0, 4, (6, 7)), rng.integers(0, 3, 7)
    _, grads = net.gradients(steps, labels)
    for w, g in zip(net.weights(), grads, strict=True):
        for _ in range(4):
            at = tuple(int(rng.integers(0, 4 if s == 256 else s)) for s in w.shape)
            old, e = w[at], 1e-3
            w[at] = old + e
            up = net.gradients(steps, labels)[0]
            w[at] = old - e
            down = net.gradients(steps, labels)[0]
            w[at] = old
            assert abs((up - down) / 2 / e - g[at]) < 2e-3


def slow_sums(net, raw):
    """Probabilities summed over a text's bytes, byte by byte over the whole text."""
    states = []
    for d in range(2):
        own, hidden = net.recurrent[d], net.recurrent[d].shape[0]
        state, out = np.zeros(hidden), []
        for byte in (b" " + raw + b" ")[:: 1 - 2 * d]:
            x, u = net.tables[d][byte], state @ own
            z, r = np.split(1 / (1 + np.exp(-(x[: 2 * hidden] + u[: 2 * hidden]))), 2)
            n = np.tanh(x[2 * hidden :] + r * (u[2 * hidden :] + net.inner[d]))
            state = (1 - z) * n + z * state
            out.append(state)
        states.append(np.stack(out[:: 1 - 2 * d]))
    logits = np.exp(np.concatenate(states, 1) @ net.out + net.bias)
    return (logits / logits.sum(1, keepdims=True))[1:-1].sum(0)


def test_reader_equals_slow_loop(monkeypatch):
    net = language.train([("a", b"words of one language and more"), ("b", "ünd Wörter der änderen".encode())], steps=40)
    rows = [b"some words here", b"x", "é wörd".encode() * 9, b"", b"\xff\xfe 12 \n\n a" * 40, b"other words there"]
    want = np.stack([slow_sums(net, x) if x else np.zeros(2) for x in rows])
    assert np.allclose(language.Reader(net).sums(rows), want, atol=1e-3)
    monkeypatch.setattr(language, "SEGMENT", 50)
    monkeypatch.setattr(language, "LANES", 3)
    assert np.allclose(language.Reader(net).sums(rows), want, atol=0.05)


@pytest.mark.parametrize("factor", [1, 200])
def test_reader_has_a_column_per_lane(factor):
    """op10: a step's arrays run along the lanes, not along a lane's few units; and weights whose exponentials overflow give the network's own probabilities."""
    net = language.Network.start(["a", "b", "c"])
    for w in [*net.tables, *net.recurrent]:
        w *= factor
    rng = np.random.default_rng(3)
    lanes = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (40, 40, 31, 7, 1)]
    scores = language.Reader(net).scores(lanes)
    assert scores.shape == (40, 3, 5) and np.isfinite(scores).all()
    for k, raw in enumerate(lanes):
        want = net.positions(np.frombuffer(raw, np.uint8)[:, None])[:, 0]
        assert np.allclose(language._softmax(scores[: len(raw), :, k]), want, atol=1e-5 if factor == 1 else 1e-3)


@given(st.binary(max_size=400), st.integers(1, 90), st.integers(0, 20))
def test_segments_label_every_byte_once(raw, size, warm):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language, "SEGMENT", size)
        patch.setattr(language, "WARM", warm)
        got = language.segments(raw)
    assert b"".join(x[a:b] for x, a, b in got) == raw and all(len(x) <= size + 2 * max(1, warm) for x, _, _ in got)


def test_sample_is_bounded(spark):
    """Rows that share an id, and very long texts, do not make the sample larger."""
    rows = [(1, "many rows of one id", "xx")] * 400 + [(k, "word " * 30_000, "yy") for k in range(2, 9)] + [(None, "no id", "zz"), (9, None, "zz"), (10, "", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.training_rows(df, "doc_id", "text", "lang", None, 20, 6).collect()
    assert Counter(r.lang for r in got) == {"xx": 20 * 6, "yy": 7 * 6} and all(len(r.window) <= language.WINDOW for r in got)


def test_one_label_or_none(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, "more", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(df, language.fit(df)).collect()} == {"und"}
    one = df.withColumn("lang", df.text)
    net = language.train([("xx", b"word")], steps=3)
    assert [tuple(r) for r in language.identify(one, net).select("lang_pred", "score").collect()] == [("xx", 1.0)] * 2


# 9


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (7, 3)])
def test_line_runs(spark, monkeypatch, batches, fanout):
    """Lines lost, by runs of several levels, against counters; ids repeat, are null, and one line is very common."""
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    monkeypatch.setattr(linededup, "BOUND_IDS", 40)
    monkeypatch.setattr(linededup.LineRuns.__init__, "__defaults__", (40, 5, fanout))
    rnd = random.Random(12)
    lines = [f"{k:03} " + "y" * 40 for k in range(30)]
    rows = [(rnd.choice([None, *range(60)]), "\n".join([lines[0], *rnd.choices(lines, k=3)])) for _ in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    holders = defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            holders[linededup.key_of(x.encode())].add(i)
    order = lambda i: -1 if i is None else i
    want = defaultdict(set)
    for key, ids in holders.items():
        if len(ids) >= 5:
            for i in ids - {max(ids, key=order)}:
                want[i].add(key)
    assert {r.id: set(map(bytes, r["keys"])) for r in linededup.dropped_lines(df, batches=batches).collect()} == want


def test_runs_are_merged_and_joined_in_place(spark):
    """Neither compaction nor the join of a batch moves or sorts a run."""
    runs = linededup.LineRuns(spark, fanout=3)
    for a in (300, 200, 100):
        lines = spark.range(a, a + 150).selectExpr("id", "cast(sha2(cast(id % 170 as string), 256) as binary) AS key")
        if a < 300:
            last = runs.runs()[-1]
            plan = runs._pair(last, last.where("n > 1"))._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Sort " not in plan and "SortMergeJoin" in plan
        runs.add(lines)
    assert [len(x) for x in runs.levels] == [0, 1]
    got = {bytes(r.key): (r.n, r["last"]) for r in runs.levels[1][0].collect()}
    ids = [i for a in (300, 200, 100) for i in range(a, a + 150)]
    import hashlib

    for k in range(170):
        own = [i for i in ids if i % 170 == k]
        assert got[hashlib.sha256(str(k).encode()).hexdigest().encode()] == (len(own), max(own))


@pytest.mark.parametrize("size", [8 << 20, 300])
def test_share_of_covered_words(spark, monkeypatch, size):
    """Ranges of several passes that overlap count once."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    rnd = random.Random(3)
    text = [f"w{rnd.randint(0, 9999)}" for _ in range(50)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:20])), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(text[k : k + 10])) for k in range(18)], "item_id long, text string")
    kept = {s: sorted(r.doc_id for r in decontaminate.decontaminated(docs, items, share=s).collect()) for s in (0.0, 0.5, 0.6, 1.0)}
    assert kept == {0.0: [3], 0.5: [3], 0.6: [1, 3], 1.0: [1, 2, 3]}


def test_files_of_other_attempts_are_not_read(spark, odd):
    docs = documents(spark, odd, "doc_id", "text")
    folder = eliasfano._folder(spark, "twice")
    path = TOKENIZERS + eliasfano.TOKENIZER
    eliasfano.write_ids(docs, folder, path, 1, lowered=True).collect()
    made = eliasfano.write_ids(docs, folder, path, 1, lowered=True).collect()
    assert eliasfano.read_ids(spark, folder, sorted((r.file, r.n_ids) for r in made)).count() == docs.count()
