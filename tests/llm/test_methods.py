"""The methods inside the operators against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyman.llm import archives, main_text, mixing, near_dups, packing, quality, sharding, suffixes, vectors
from tallyman.llm.graph import components
from tallyman.llm.packing_queries import tokenizer_path
from tallyman.llm.words import column_words, shingle_sets, split_words, text_buffers, window_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def a_text(rng: random.Random, n: int, words: int = 40) -> str:
    return "".join(f"w{rng.randrange(words)}" + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(n))


def test_words_are_those_of_the_pattern():
    texts = ["", " a", "a", "Ä b\x0bc\x1cd", None, "x" * 5000, "\n\n", "a a A"]
    (_, _, words), = column_words(pa.array(texts))
    found = [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends)]
    want = [WORD.findall((t or "").encode()) for t in texts]
    assert found == [w for ws in want for w in ws]
    assert list(words.counts) == [len(w) for w in want]
    by_hash = {}
    for h, w in zip(words.hashes, found):
        assert by_hash.setdefault(int(h), w) == w
    assert len(by_hash) == len(set(found))


def test_slices_and_array_offsets_change_nothing():
    rng = random.Random(1)
    texts = [a_text(rng, rng.randrange(40)) for _ in range(50)]
    (_, _, whole), = column_words(pa.array(texts))
    data, begins = text_buffers(pa.array(["gone", *texts]).slice(1))
    assert (split_words(data, begins).hashes == whole.hashes).all()


@pytest.mark.parametrize("size", [3, 5, 20, 50])
def test_window_hashes_are_equal_where_words_are(size):
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2, 400).astype(np.uint64) * np.uint64(99991)
    hashes = window_hashes(words, size, 1)
    assert len(hashes) == len(words) - size + 1
    seen = {}
    for i, h in enumerate(hashes):
        assert seen.setdefault(int(h), tuple(words[i : i + size])) == tuple(words[i : i + size])
    assert len(seen) == len({tuple(words[i : i + size]) for i in range(len(hashes))})


def test_every_window_has_the_minimiser_that_is_said():
    grams = np.random.default_rng(3).integers(0, 30, 500).astype(np.uint64)
    places, first, last = suffixes.minimisers(grams, 31)
    for p, a, b in zip(places, first, last):
        for start in range(a, b + 1):
            assert p == start + int(np.argmin(grams[start : start + 31]))
    assert (last - first + 1).sum() == len(grams) - 30


def odd_bits(a, b):
    return np.bitwise_count((near_dups.odd_sketch(a) ^ near_dups.odd_sketch(b)).view(np.uint64)).sum()


def test_odd_sketches_let_every_link_pass():
    """Sets at the threshold, from small to large, and what is far off is refused."""
    rng = np.random.default_rng(4)
    for size, trials in ((1, 5), (7, 60), (40, 60), (600, 40), (5000, 20), (60_000, 4)):
        for _ in range(trials):
            common = rng.integers(0, 1 << 63, size, np.uint64)
            extra = max(0, int(size * 0.15 / 0.85))
            cut = int(rng.integers(0, extra + 1))
            a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, cut, np.uint64)]) * np.uint64(2))
            b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, extra - cut, np.uint64)]) * np.uint64(2))
            odd = odd_bits(a, b)
            assert odd <= min(near_dups.most_odd_bits(float(len(a) + len(b)), 85))
        if size >= 40:
            far = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
            odd = odd_bits(a, far)
            assert odd > min(near_dups.most_odd_bits(float(len(a) + len(far)), 85))


def brute_components(nodes, links):
    low = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_near_duplicates_against_all_pairs(spark):
    """A group of copies of copies, in which many pairs of one bucket are no links."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        words = list(rng.choice(texts).split()) if texts and rng.random() < 0.6 else list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    (_, _, words), = column_words(pa.array(texts), lower=True)
    sets = [set(s.tolist()) for s in shingle_sets(words, 3)]
    links = [(i, j) for i, j in itertools.combinations(range(150), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == brute_components(range(150), links)
    assert len(set(got.values())) > 5


def test_components_of_paths_and_stars(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    low = brute_components(sorted(nodes), [(a, b) for a, b in links if a != b])
    assert got == low


def test_exponent_meets_its_limits(spark):
    shares = [0.6, 0.2, 0.1, 0.06, 0.04]
    df = spark.createDataFrame([(p,) for p in shares], "p double")
    entropy = lambda a: (lambda w: -sum(x * math.log(x) for x in w))([p**a / sum(q**a for q in shares) for p in shares])
    step = mixing.find_exponent(df, 0.95, 1e9)
    assert entropy(step / mixing.STEPS) >= 0.95 * math.log(5) > entropy((step + 1) / mixing.STEPS)
    limited = mixing.find_exponent(df, 0.999, 3.0)
    assert (0.6 / 0.04) ** (1 - limited / mixing.STEPS) <= 3.0 < (0.6 / 0.04) ** (1 - (limited - 1) / mixing.STEPS)
    assert mixing.find_exponent(df.limit(1), 0.9, 2.0) == mixing.STEPS


def test_mixture_meets_its_quotas(spark):
    rng = random.Random(7)
    rows = [(i, "big" if i < 400 else f"s{i % 7}", "t " * rng.randrange(1, 60)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    used = mixing.mix_sources(df, max_passes=8.0, block_tokens=2000).toPandas()
    tokens = used.groupby("source").n_tokens.sum()
    shares = tokens / tokens.sum()
    entropy = -(shares * np.log(shares)).sum() / math.log(len(shares))
    assert 0.94 < entropy < 0.97
    whole = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in tokens.index}
    assert tokens["big"] == whole["big"]  # passed over once
    copies = used.groupby("doc_id")["pass"].agg(["count", "max"])
    assert len(copies) == 600 and (copies["count"] == copies["max"] + 1).all()
    # Each full block holds the sources near their weights.
    full = used[used.block < used.block.max()]
    per_block = full[full.source == "big"].groupby("block").n_tokens.sum() / full.groupby("block").n_tokens.sum()
    assert (abs(per_block - shares["big"]) < 0.12).all()


@pytest.mark.parametrize("seed", range(4))
def test_minimax_borders_against_all_capacities(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "ROOT_BITS", 3)
    rng = random.Random(seed)
    keys = sorted(rng.sample(range(1 << sharding.KEY_BITS), 200))
    sizes = [rng.choice([8, 20, 100, 3000 if seed == 3 else 90]) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long")
    borders, capacity = sharding.minimax_borders(df, 7)

    def shards(limit):
        n, room = 1, limit
        for s in sizes:
            if s > limit:
                return len(sizes)
            if s > room:
                n, room = n + 1, limit
            room -= s
        return n

    assert shards(capacity) <= 7 < shards(capacity - 1)
    cuts = [0, *[keys.index(b) for b in borders], len(keys)]
    assert max(sum(sizes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])) == capacity and len(borders) <= 6


@pytest.mark.parametrize("share", [0.0, 0.0425, 0.05, 1 / 3])
def test_hot_group_opens_few_prefixes(spark, share, monkeypatch):
    """One group of a third of all bytes neither brings all groups to the driver nor asks for all prefixes."""
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 1 << sharding.KEY_BITS, 20_000))
    sizes = rng.integers(8, 20_000, len(keys))
    if share:
        sizes[7_000] = int(sizes.sum() * share / (1 - share))
    held, asked = [], []
    refine = sharding._Order.refine

    def counted(self, at):
        asked.append(len(at))
        refine(self, at)
        held.append(len(self.nodes))

    monkeypatch.setattr(sharding._Order, "refine", counted)
    df = spark.createDataFrame(list(zip(keys.tolist(), sizes.tolist())), "key long, size long")
    borders, capacity = sharding.minimax_borders(df, 24)
    assert max(asked) <= 1024 and max(held) <= 12_000 and len(asked) <= 40
    cuts = [0, *np.searchsorted(keys, borders), len(keys)]
    assert capacity == sharding._smallest(sizes, 24)
    assert max(sizes[a:b].sum() for a, b in zip(cuts[:-1], cuts[1:])) <= capacity and len(borders) <= 23


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 4000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    plan = packing.best_plan(counts)
    placed, fills = {}, {}
    for length, rank, count, first, offset in plan.runs:
        for k in range(count):
            assert (length, rank + k) not in placed
            placed[length, rank + k] = (first + k, offset)
            fills.setdefault(first + k, []).append((offset, length))
    assert set(placed) == {(int(n), r) for n in np.unique(lengths) for r in range(counts[n])}
    for parts in fills.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    bound = -(-int(lengths.sum()) // 2048)
    assert len(fills) == plan.sequences <= 1.01 * bound + 1


def test_word_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    rng = random.Random(8)
    odd = ["a\x01b c", "<|endoftext|> x<|startoftext|>.", "don't!! it's... x'y 'tis", "éte ́a É.", "f12, a1b2;", "\x1cab\x1d", "“q”. end—.", "İx. ʼs 'S 'LL", "", "x" * 2000]
    texts = odd + ["".join(rng.choice("ab'Zé.,%<|> \n1") for _ in range(60)) for _ in range(300)]
    mine, plain = packing.WordTokens(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    texts += [" ".join("".join(rng.choice("abcXYZéÉàÀßøØÿÝíÍáÁ") for _ in range(rng.randrange(1, 15))) for _ in range(400)), "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ ×÷ a×b e\u0301 E\u0301a"]
    texts += [" \n lead and trail\t ", "\x0b\x0c", None]
    for column in (pa.array(texts), pa.array(["gone", *texts]).slice(1)):
        ids, edges = mine.encode(column.cast(pa.large_string()).fill_null(""))
        for text, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
            assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_words_that_are_forgotten_are_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "BYTES_KEPT", 8)
    mine = packing.WordTokens(tokenizer_path())
    texts = pa.array(["some words. and", "others, and some"], pa.large_string())
    first = mine.encode(texts)
    for _ in range(3):
        again = mine.encode(texts)
        assert first[0].tolist() == again[0].tolist() and first[1].tolist() == again[1].tolist()


def test_labelled_blocks_and_unseen_pages():
    x, y = main_text.labelled_blocks()
    tree = main_text.grow_tree(x, y)
    assert (main_text.apply_tree(tree, x) == (y == 1)).mean() > 0.97
    page = (
        "<html><head><title>No</title><script>var a='<p>no</p>';</script></head><body><nav><a href=/>no</a></nav>"
        "<div class='cookie-notice'>no no</div><article><h1>Head &amp; line</h1><p>One <b>two</b><br>three&nbsp;four"
        "<p>Five</p><div id=ads>no</div><form>no<input></form><!-- no --><section class='comments'><p>" + "no " * 40
        + "</p></section></article><aside>no</aside><footer>no</footer></body>"
    )
    assert main_text.main_text(page, tree) == "Head & line\n\nOne two three four\n\nFive"


def test_arc_versions_and_broken_records():
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nxy\nz"
    for version, middle in ((1, ""), (2, "200 - - 0 f.arc ")):
        opening = f"{version} 0 Origin\n{archives.ARC_FIELDS[version]}\n"
        data = (
            f"filedesc://f.arc 0.0.0.0 1996 text/plain {middle}{len(opening)}\n{opening}\n"
            f"http://a b 1.2.3.4 19960102030405 text/html {middle}{len(body)}\n"
        ).encode() + body + b"\n"
        opens, record = archives.parse_arc(data)
        assert opens.opens_file and record.content == body and record.fields["URL"] == "http://a b"
        with pytest.raises(ValueError, match="cut short"):
            list(archives.parse_arc(data[:-4]))
    with pytest.raises(ValueError, match="fields"):
        list(archives.parse_arc(b"http://a 1.2.3.4\nx"))
    assert archives.iso_time("19960102") == "1996-01-02T00:00:00Z"


def test_archives_give_back_every_byte(spark, tmp_path):
    rng = random.Random(9)
    pages = [(i, f"http://h/{i}", "".join(rng.choice("aä\r\n<WARC/1.1 ") for _ in range(rng.randrange(400)))) for i in range(60)]
    pages += [(100 + i, "http://copy", pages[i][2]) for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    archives.write_arc(df, arc)
    archives.convert_arc(spark, arc, warc)
    back = archives.read_warc(spark, warc).collect()
    by_key = {r.key: r for r in back}
    ids = {r.record_id: r for r in back}
    assert len(back) == len(ids) == len(pages)
    for key, url, text in pages:
        r = by_key[key]
        origin = ids[r.refers_to] if r.record_type == "revisit" else r
        assert origin.payload == text.encode() and r.payload_bytes == len(text.encode()) and r.uri == url


@pytest.mark.parametrize("cells", [1, 6])
def test_vectors_against_all_pairs(spark, cells, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 10**9 if cells == 1 else 40)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(10)
    near = rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(120, 8))
    x = np.concatenate([near, rng.normal(size=(250, 8)), near[:30]]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = (unit @ unit.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None, :] % 2)
    np.fill_diagonal(linked, False)
    low = brute_components(range(len(x)), np.argwhere(linked).tolist())
    assert got == {i: (int(linked[i].sum()), low[i]) for i in range(len(x))}


def test_origin_of_copies_of_a_near_copy(spark):
    """Equal texts that begin as an earlier text does name that one, all of them."""
    base = [f"w{i}" for i in range(120)]
    near = " ".join(base[:80] + ["other"] + base[81:])
    fresh = " ".join(f"v{i}" for i in range(70))
    quoting = " ".join(["before"] + base)
    rows = [
        (5, " ".join(base)), (9, near), (7, near), (8, near),
        (11, fresh), (12, fresh),
        (20, quoting), (21, quoting),
    ]
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    origins = {(r.doc_id, r.start, r.stop): r.origin for r in got}
    # 5 is repeated throughout by 20, which begins with a word of its own.
    assert origins == {
        (5, 0, 120): 5, (7, 0, 120): 5, (8, 0, 120): 5, (9, 0, 120): 5,
        (11, 0, 70): 11, (12, 0, 70): 11, (20, 0, 121): 20, (21, 0, 121): 20,
    }
    cuts = {r.doc_id: (r.cut_from, r.cut_to) for r in got}
    assert cuts[8] == cuts[9] == ([0], [120]) and cuts[20] == ([1], [121]) and cuts[21] == ([0], [121])


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 6))
    p = 1 / (1 + np.exp(-2 * (x[:, 0] * x[:, 1] + x[:, 2])))
    y = (rng.random(3000) < p).astype(float)
    check = np.arange(3000) % 4 == 0
    net = quality.fit_network(x, y, check)
    assert np.mean(abs(net.scores(x[check]) - p[check])) < 0.1


def test_quality_on_documents_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score_quality(docs.select("doc_id", "text"), labels).select("row.doc_id", "score")
    held = scored.join(labels, "doc_id").filter(quality.fold_of("doc_id") == 0).toPandas()
    assert ((held.score >= quality.THRESHOLD) == (held.quality == 1)).mean() >= 0.95


def test_quality_does_not_depend_on_the_order_of_rows_with_one_id(spark):
    rng = random.Random(5)
    rows = [(i, a_text(rng, 60, 40 if i % 2 else 4000)) for i in range(60) for _ in range(5)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    scores = []
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[1])):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        scored = quality.score_quality(docs, labels, max_labelled=60)
        scores.append({(r.doc_id, r.text): r.score for r in scored.select("row.*", "score").collect()})
    for other in scores[1:]:
        assert other.keys() == scores[0].keys()
        assert max(abs(other[k] - scores[0][k]) for k in other) < 1e-9


def test_packing_of_a_table_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {}
    for doc, text in docs.collect():
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for a in range(0, len(ids), 2048):
            own = ids[a : a + 2048]
            want[doc, a // 2048] = (a, len(own), zlib.crc32(own.tobytes()))
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= -(-total // 2048) + 2


def test_pipeline_stage_by_stage(spark):
    """Each stage on its predecessor's rows, against plain versions of what it decides."""
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, step in pipeline.STAGES:
        before, docs = docs, pipeline.stage(step(spark, docs, sf), name)
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == names and docs.schema["n_chars"].dataType == before.schema["n_chars"].dataType
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    gone = set(ids(kept["quality"][0])) - set(ids(kept["quality"][1]))
    assert sum(labels.get(d) == 1 for d in gone) <= 0.03 * len(labels) and any(labels.get(d) == 0 for d in gone)
    # Near duplicates: the smallest id of each component of all pairs.
    rows = {r.doc_id: r.text for r in kept["near_duplicates"][0].collect()}
    order = sorted(rows)
    (_, _, words), = column_words(pa.array([rows[d] for d in order]), lower=True)
    sets = dict(zip(order, [set(s.tolist()) for s in shingle_sets(words, 5)]))
    links = [(a, b) for a, b in itertools.combinations(order, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = brute_components(order, links)
    assert ids(kept["near_duplicates"][1]) == sorted(d for d in order if low[d] == d)
    # Repeats: no passage of 50 words is left twice, and nothing else went.
    left = kept["repeated_passages"][1].collect()
    seen = set()
    for r in sorted(left, key=lambda r: r.doc_id):
        w = r.text.split()
        own = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        assert not own & seen and r.n_chars == len(r.text)
        seen |= own
    assert set(ids(kept["mixture"][1])) == set(ids(kept["mixture"][0]))
    pieces = kept["packing"][1]
    assert pieces.filter("piece = 0").count() == kept["packing"][0].count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()
    assert sorted(r.doc_id for r in pipeline.run(spark, sf).collect()) == ids(pieces)
