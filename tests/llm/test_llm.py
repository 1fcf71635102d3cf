"""The training-data operators against brute force, round trips and hand-made edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, disclosure, linededup, mixing, ngramjoin, ngramlm, packing, quality, transport, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, q_text string, mix_size int, line_batch int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts, ids=None):
    """Documents, with extra columns whose names clash with what operators use inside."""
    ids = ids or range(len(texts))
    rows = [(i, t, None if k % 7 == 3 else "en", None if k % 5 == 2 else f"s{k % 3}", len(t or ""), "p", "q", 1, 2) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed: int, n: int, words: int = 60) -> list[str]:
    r = random.Random(seed)
    bag = ["".join(r.choices("aeioustrn", k=r.randint(2, 9))) for _ in range(400)]
    return [" ".join(r.choices(bag, k=words)) for _ in range(n)]


EDGES = [None, "", " \n\t", "one", "one", "Ünï çödé wörds\nwith lines that repeat here\nwith lines that repeat here", "with LINES that repeat here ", "x" * 20000,
         "long " * 3000, "<|im_end|> & &lt;|", "mail a@b.cd 10.0.0.1 +1 202 555 0175 4111 1111 1111 1111", "\x00\x1c odd", "one two three four five six"]


@pytest.mark.parametrize("op", [linededup.line_report, quality.document_quality, quality.keep_good, mixing.mixture, mixing.curriculum, packing.packed,
                                transport.media_report, ngramjoin.linked_documents, ngramjoin.drop_near_duplicates, ngramlm.scored,
                                disclosure.disclosure_report, disclosure.sanitised, linededup.dedup_lines], ids=lambda f: f.__name__)
def test_edges_and_empty(spark, op):
    docs = table(spark, [*EDGES, *EDGES[:3]], [*range(len(EDGES)), None, 0, 1])
    frame = op(docs)
    out = frame.collect()
    if op in (quality.keep_good, ngramjoin.drop_near_duplicates, mixing.curriculum, disclosure.sanitised):
        assert frame.columns == docs.columns
    elif op is packing.packed:
        assert sum(r["length"] for r in out if r["doc_id"] == 0) == 2      # null and empty: one closing token each
    else:
        assert len(out) == docs.count()
    assert op(docs.limit(0)).collect() == []


def brute_links(texts: dict) -> dict:
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    head = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((head[i], head[j]))
                head = {k: a if v == b else v for k, v in head.items()}
    return {i: (len(sets[i]), head[i]) for i in sets}


@pytest.mark.parametrize("leaf", [8192, 3])
def test_join_is_exact(spark, monkeypatch, leaf):
    r, base = random.Random(5), prose(1, 12)
    texts = list(EDGES[1:]) + base * 2
    for b in base[:4]:
        for _ in range(15):
            w = b.split()
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(["new", "other", "words"])
            texts.append(" ".join(w))
    shared = " ".join(prose(9, 1, 40))
    texts += [shared + " " + t for t in prose(3, 12, 12)]
    monkeypatch.setattr(ngramjoin, "LEAF_DOCUMENTS", leaf)
    monkeypatch.setattr(ngramjoin, "PIVOTS_LEAST", 4)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngramjoin.linked_documents(table(spark, texts)).collect()}
    want = brute_links(dict(enumerate(texts)))
    assert got == want and any(k != v[1] for k, v in want.items())
    kept = {x["doc_id"] for x in ngramjoin.drop_near_duplicates(table(spark, texts)).collect()}
    assert kept == {k for k, v in want.items() if v[1] == k}


def test_blocks_stay_whole_when_joins_turn_small(spark):
    """A join that Spark turns into a broadcast while it runs leaves rows where they lay; blocks are dealt anew all the same."""
    held = [(k // 2, 7 * k + 1, 20, np.arange(20 * (k // 2), 20 * (k // 2) + 20).tobytes()) for k in range(400)]
    members = ngramjoin.cut(spark.createDataFrame(held, "block long, node long, n long, shared binary").repartition(8, "node"))
    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(parts)
    spark.conf.set(parts, spark.conf.get("spark.sql.shuffle.partitions"))    # where both are equal, a repartitioning may be left out
    try:
        sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("members"))
        joined = ngramjoin._join_blocks(members.join(sizes, "block").where("members = 2"))
        plan, got = joined._jdf.queryExecution().executedPlan().toString(), joined.collect()
    finally:
        spark.conf.set(parts, before)
    assert "REPARTITION_BY_NUM" in plan
    assert {(r["node"], r["component"]) for r in got} == {(7 * k + 1, 7 * (k - k % 2) + 1) for k in range(400)}


def test_blocks_hold_only_what_can_be_linked(spark, monkeypatch):
    """Edited copies of a text that are too far from it and from each other share most places with the near ones, but no block."""
    r, base = random.Random(11), prose(21, 1, 120)[0].split()

    def edited(k: int, mark: str) -> str:
        w = list(base)
        for n, at in enumerate(r.sample(range(5, 115, 6), k)):
            w[at] = f"{mark}{n}"
        return " ".join(w)
    texts = [" ".join(base), *(edited(1, f"near{k}x") for k in range(10)), *(edited(5, f"far{k}x") for k in range(40))]
    monkeypatch.setattr(ngramjoin, "LEAF_DOCUMENTS", 15)
    monkeypatch.setattr(ngramjoin, "_split_large", lambda *a: pytest.fail("a block was too large"))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngramjoin.linked_documents(table(spark, texts)).collect()}
    want = brute_links(dict(enumerate(texts)))
    assert got == want and sum(v[1] == 0 for v in want.values()) == 11


def test_groups_and_places_against_all_pairs():
    r = np.random.default_rng(3)
    for _ in range(150):
        base, m = r.integers(0, 300, (3, 60)), int(r.integers(2, 40))
        sets = []
        for _ in range(m):
            x = base[r.integers(0, 3)].copy()
            x[r.integers(0, 60, int(r.integers(0, 25)))] = r.integers(0, 400)
            sets.append(np.unique(x[:int(r.integers(20, 61))]))
        sizes = np.array([len(x) + int(r.integers(0, 4)) for x in sets])
        head, apart = list(range(m)), list(range(m))
        most = np.array([ngramjoin.largest_partner(int(n), int(n) - int(r.integers(0, 20))) for n in sizes])
        for i in range(m):
            for j in range(i):
                if ngramjoin.links(int(sizes[i]), sizes[j:j + 1], np.array([len(np.intersect1d(sets[i], sets[j]))]))[0]:
                    a, b = sorted((head[i], head[j]))
                    head = [a if v == b else v for v in head]
                if sizes[i] <= most[j] and sizes[j] <= most[i]:
                    a, b = sorted((apart[i], apart[j]))
                    apart = [a if v == b else v for v in apart]
        assert ngramjoin._groups(sizes, sets).tolist() == head
        row = pa.RecordBatch.from_pydict({"place": np.zeros(m, np.int64), "node": np.arange(m), "n": sizes, "most": most})
        met = {k: v for b in ngramjoin._meetings(iter([row])) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        assert [met.get(i, i) for i in range(m)] == apart


def test_owners_take_bytes_by_their_ngrams():
    r = np.random.default_rng(4)
    for sets, held in ((5000, 0), (5000, 40), (5000, 4999), (50, 5000), (3, 100_000), (3_000_000, 5)):
        owner = np.sort(r.integers(0, sets, held))
        raw = ngramjoin._packed(owner, sets)
        assert ngramjoin._owners(raw).tolist() == owner.tolist() and len(raw) <= 4 * held + 2


def brute_lines(texts: dict) -> dict:
    holders: dict[str, set] = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    return {i: [x for x in (t or "").split("\n") if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i] for i, t in texts.items()}


def test_lines_and_their_deletion(spark):
    r, bag = random.Random(2), [p[:60] for p in prose(4, 30, 12)]
    texts = {i: "\n".join(r.choices(bag, k=6)) for i in range(40)} | {100: None, 101: "\n", 102: "kürze   \nüüüüüüüüü\n" + bag[0].upper()}
    docs = table(spark, list(texts.values()), list(texts))
    got = {x["doc_id"]: x for x in linededup.dedup_lines(docs).collect()}
    want = brute_lines(texts)
    assert {i: x["text"] for i, x in got.items()} == {i: "\n".join(v) for i, v in want.items()}
    assert all(x["n_lines"] - x["n_dropped"] == len(want[i]) for i, x in got.items())
    # taking documents back leaves the state that the others alone would have made
    first, later = docs.where("doc_id < 20"), docs.where("doc_id >= 20")
    grown = linededup.insert_documents(linededup.insert_documents(None, first, 4), later, 4)
    table_of = lambda s: sorted(map(tuple, linededup.holders(s).collect()))
    assert table_of(grown) == table_of(linededup.insert_documents(None, docs, 4))
    assert table_of(linededup.delete_documents(grown, first, later, 4)) == table_of(linededup.insert_documents(None, later, 4))


def test_cuckoo_filter_keeps_and_forgets():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64))
    f = linededup.CuckooFilter()
    f.insert(keys[:30_000], keys[:0])
    f.insert(keys[30_000:], keys[:30_000])
    assert f.contains(keys).all()
    f.remove(keys[:30_000])
    assert f.contains(keys[30_000:]).all() and f.contains(keys[:30_000]).mean() < 0.01


def test_packing_round_trip(spark):
    texts = [*EDGES, *(" ".join(prose(k, 1, 5 + 37 * (k % 90))) for k in range(120))]
    rows = packing.packed(table(spark, texts)).collect()
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.public_tokenizer())
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in own)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = pad = 0
    for own in sequences.values():
        ends = 0
        for at, n in sorted(own):
            assert at == ends
            ends += n
        assert ends <= 2048
        total, pad = total + ends, pad + (0 if ends & (ends - 1) == 0 else 2048 - ends)
    assert pad <= 0.02 * total + 2048 * spark.sparkContext.defaultParallelism


def test_model_equals_brute_force(spark):
    texts = dict(enumerate([*EDGES, *prose(8, 60, 30)]))
    got = {x["doc_id"]: x for x in ngramlm.scored(table(spark, list(texts.values()))).collect()}
    tokens = {i: WORD.findall((t or "").translate(LOWER)) + ["\n"] for i, t in texts.items()}
    one, two, before = Counter(), Counter(), Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(t)
            two.update(zip([" ", *t], t, strict=False))
            before.update([" ", *t[:-1]])
    n, v = one.total(), len(one)
    for i, t in tokens.items():
        single = [(one[w] + 1) / (n + v + 1) for w in t]
        score = sum(math.log10((two[c, w] + ngramlm.MU * p) / (before[c] + ngramlm.MU)) for c, w, p in zip([" ", *t], t, single, strict=False))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(one[w] > 0 for w in t), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(map(math.log10, single))) and r["score"] == pytest.approx(score)


def test_elias_fano_and_quantised_counts():
    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 2**40, 70_000), rng.integers(0, 50, 4000), np.arange(3000), np.array([0]), np.array([2**40]), np.empty(0, np.int64)):
        values = np.sort(values).astype(np.uint64)
        back, _ = ngramlm.EliasFano.open(ngramlm.EliasFano.of(values).tobytes(), 0)
        assert (back.values(np.arange(len(values))) == values).all()
        assert (back.find(values) == np.searchsorted(values, values)).all()
        absent = np.setdiff1d(np.r_[values + np.uint64(1), np.uint64(2**41)], values)
        assert (back.find(absent) == -1).all()
        if len(values):     # between bounds, the first equal one in them
            at = np.arange(len(values))
            assert (back.find(values, at, at + 1) == at).all() and (back.find(values, at, at) == -1).all()
    counts = np.r_[np.arange(1, 70_000), 2 ** np.arange(17, 60)]
    code = ngramlm.quantised(counts)
    assert (np.diff(code.astype(int)) >= 0).all() and (ngramlm.counts_of(code)[:2**15] == counts[:2**15]).all()
    assert np.abs(ngramlm.counts_of(code) / counts - 1).max() < 0.0006
    assert (ngramlm.quantised(counts[40_000:]) == code[40_000:]).all()      # whatever else a shard holds


def test_trie_is_read_where_it_lies(tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    context, word = rng.integers(0, 3000, 200_000).astype(np.uint64) << np.uint64(20), rng.integers(0, 5000, 200_000).astype(np.uint64) << np.uint64(17)
    raw = ngramlm.Trie.build(context, word, np.ones(len(word), np.int64))
    (tmp_path / "levels").write_bytes(raw)
    trie = ngramlm.Trie(np.memmap(tmp_path / "levels", np.uint8, "r"))
    want = Counter(zip(context.tolist(), word.tolist(), strict=True))
    pairs = [(c << 20, w << 17) for c in range(0, 3100, 7) for w in range(0, 5100, 11)]
    asked = [np.array(x, np.uint64) for x in zip(*pairs, strict=True)]
    assert trie.numerators(*asked).tolist() == [want[p] for p in pairs]
    # the levels take less than 4 bytes a bigram and are views of the file
    assert len(raw) < 4 * len(want)
    for level in (trie.words, trie.contexts, trie.pointers, trie.successors):
        assert not any(x.flags.owndata for x in (level.low_bytes, level.high_bytes, level.before))
    # without the pointers the successors mean nothing
    find = ngramlm.EliasFano.find
    monkeypatch.setattr(ngramlm.EliasFano, "find", lambda self, asked, begin=0, end=None: find(self, asked))
    assert trie.numerators(*asked).tolist() != [want[p] for p in pairs]


def test_a_kept_model_answers_alike(spark, tmp_path):
    texts = [*EDGES, *prose(8, 60, 30)]
    docs = table(spark, texts)
    ngramlm.trained(docs).write.parquet(str(tmp_path / "model"))
    model = spark.read.parquet(str(tmp_path / "model"))
    rows = lambda df: {r["doc_id"]: tuple(r)[1:5] + tuple(round(x, 9) for x in tuple(r)[5:]) for r in df.collect()}
    assert rows(ngramlm.scored_by(docs, model)) == rows(ngramlm.scored(docs))
    # other texts: those of the model's score as before, under any ids and beside words it never saw
    other = rows(ngramlm.scored_by(table(spark, [texts[20], "never seen before", None], [5020, 5021, 5022]), model))
    assert other[5020][3:] == rows(ngramlm.scored(docs))[20][3:] and other[5021][2] == 1
    none = rows(ngramlm.scored_by(docs.limit(3), model.limit(0)))
    assert len(none) == 3 and all(r[2] == 0 and r[3] == 0 for r in none.values())
    assert ngramlm.scored_by(docs.limit(0), model).count() == 0


def test_transport_streams():
    for n in [0, 1, 64, 158, 170, 171, 172, 345, 5000, 32768, 32769, 140_000]:
        data = transport.padded(random.Random(n).randbytes(n))
        stream = transport.write_stream(data)
        back = transport.read_stream(stream)
        assert back["payload"] == data and back["errors"] == 0 and len(stream) % 188 == 0
        assert back["units"] == -(-len(data) // transport.UNIT) and back["random_access"] == list(range(0, back["units"], transport.RANDOM_EVERY))
    whole = transport.write_stream(transport.padded(bytes(9000)))
    assert transport.read_stream(whole[:188 * 6] + whole[188 * 7:])["errors"] > 0
    assert transport.read_stream(whole[:188 * 6] + whole[188 * 5:])["payload"] == transport.padded(bytes(9000))    # a repeated packet
    assert transport.read_stream(whole[188:])["payload"] == b"" and transport.read_stream(None)["payload"] == b""


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "a <|im_end|>\n&lt;| <"), (1, 1, "user", "|b & <|im_sep|>"), (1, 2, "assistant", "x<"), (1, 3, "assistant", None), (1, 3, "assistant", None),
            (2, None, "a\n<|im_start|>", "t"), (None, 5, None, "n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat.chat_report(spark, frame).collect()}
    assert set(got) == {1, 2, None, -1} and got[1]["n_messages"] == 2
    for conv, own in ((1, rows[:5]), (2, rows[5:6]), (None, rows[6:])):
        told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert got[1]["loss_chars"] == 2 and got[1]["loss_sha256"] == hashlib.sha256(b"x<").hexdigest()
    assert chat.formatted(frame.limit(0)).count() == 0


def test_urls(spark):
    cases = {"http://a.example.com/en/x": "example.com/en/", "https://www.EXAMPLE.com/en/": "www.example.com/en/", "http://m.www.example.com/en/1?q": "www.example.com/en/",
             "http://x.net/es/": "net/es/", "http://x.net/esx/": None, "http://com": None, "http://com/": "com/", "http://notcom/": None, None: None, "no scheme": None, "": None,
             "http://example.com?/en/": None, "http://.com/": "com/", "x://net/fr/a://b": "net/fr/"}
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*cases, *cases])], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urlfilter.judged(pages).collect()}
    blocked = {"example.com/en/", "net/es/", "net/fr/"}
    for i, rule in enumerate([*cases.values(), *cases.values()]):
        assert (got[i]["rule"], got[i]["verdict"]) == (rule, "block" if rule in blocked else "allow")
    assert urlfilter.judged(pages.limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = urlfilter.build(universe.where("hash(key) % 9 = 0"), universe)
    rows = universe.select(*(h.alias(n) for h, n in zip(urlfilter.hashes(F.col("key")), "ab", strict=True)), F.expr("hash(key) % 9 = 0").alias("listed")).toPandas()
    assert (cascade.contains(rows["a"].to_numpy(), rows["b"].to_numpy()) == rows["listed"].to_numpy()).all() and len(cascade.levels) > 1


def test_quality_statistics_and_outliers(spark):
    r = random.Random(6)
    texts = [*EDGES, "a b c d e f g a b c d e x y a b c d e", "l one\n\nl one\nl one\nend", *prose(11, 300, 80), "### $$$ %%% &&& " * 30 + " ".join(prose(1, 1, 80))]
    got = {x["doc_id"]: x for x in quality.document_quality(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        often = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    clean = range(len(EDGES) + 2, len(texts) - 1)
    assert all(got[i]["kept"] for i in clean) and r
    kept = {x["doc_id"] for x in quality.keep_good(table(spark, texts)).collect()}
    assert kept == {i for i in got if got[i]["kept"]}


def test_mixture_reaches_targets(spark):
    texts = prose(13, 900, 20) + [None, ""]
    frame = table(spark, texts).withColumn("source", F.when(F.col("doc_id") % 10 < 7, "big").when(F.col("doc_id") % 10 == 7, "a").when(F.col("doc_id") % 10 == 8, "c"))
    rows = mixing.mixture(frame).collect()
    sizes = {"a": 0, "big": 0, "c": 0, None: 0}
    name = {r["doc_id"]: r["source"] for r in frame.collect()}
    for i, t in enumerate(texts):
        sizes[name[i]] += len(WORD.findall(t or ""))
    target, weight, total = dict.fromkeys(sizes, 0.0), {"a": 5, "big": 2, "c": 1, None: 5}, sum(sizes.values())
    stopped: set = set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        free = [s for s in sizes if s not in stopped]
        target = {s: 3.0 * sizes[s] if s in stopped else left * weight[s] / sum(weight[f] for f in free) for s in sizes}
        more = {s for s in free if target[s] > 3 * sizes[s]}
        if not more:
            break
        stopped |= more
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["target"] == pytest.approx(target[name[r["doc_id"]]]) and r["source_size"] == sizes[name[r["doc_id"]]] and r["taken"] <= 3 * r["size"]
        assert len(r["positions"]) * r["size"] == r["taken"] and all(0 <= p <= 1 for p in r["positions"])
        taken[name[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 40 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixture(frame).collect()))
    assert mixing.curriculum(frame).count() == sum(len(r["positions"]) for r in rows)


def test_terms_that_disclose_an_entity(spark):
    near = "quite ordinary words before Quazzelhof then jane.doe@mail.example and ordinary words after it, 1.2.3.999 as well"
    texts = [near + f" number {i}" for i in range(5)] + [f"quite ordinary words before then and after it, number {i} as well" for i in range(200)]
    got = {r["doc_id"]: r for r in disclosure.disclosure_report(table(spark, texts)).collect()}
    start = near.index("Quazzelhof")
    assert f"term:{start}:{start + 10}" in got[0]["spans"] and "ordinary" not in [near[int(a):int(b)] for k, a, b in (s.split(":") for s in got[0]["spans"].split(",")) if k == "term"]
    assert (got[0]["n_email"], got[0]["n_ip"]) == (1, 0) and got[10]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(table(spark, texts)).collect()}
    assert "Quazzelhof" not in clean[0] and "jane.doe" not in clean[0] and clean[10] == texts[10]


def brute_terms(texts: dict) -> dict:
    """Spans of disclosing terms, for texts whose only entities are emails."""
    email, n = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"), len(texts)
    mails = {i: [(m.start(), m.end(), m.group().lower()) for m in email.finditer(t)] for i, t in texts.items()}
    terms = {i: [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]+", t) if len(m.group()) >= 4
                 and not any(a < m.end() and m.start() < b for a, b, _ in mails[i])] for i, t in texts.items()}
    names, words = {i: {e for *_, e in x} for i, x in mails.items()}, {i: {t for *_, t in x} for i, x in terms.items()}
    with_e, with_t = Counter(e for x in names.values() for e in x), Counter(t for x in words.values() for t in x)
    both = Counter((e, t) for i in texts for e in names[i] for t in words[i])
    told = {(e, t) for (e, t), k in both.items() if k >= 3 and with_e[e] < n
            and math.log(k * n / (with_e[e] * with_t[t])) / math.log(n / with_e[e]) >= disclosure.GENERALISE}
    return {i: [(a, b) for a, b, t in x if any((e, t) in told for e in names[i])] for i, x in terms.items()}


def test_terms_disclose_anywhere_in_a_document(spark):
    r, filler = random.Random(8), "much is said about many other things in this letter before it comes to an end " * 2
    texts = [f"Quazzelhof writes\n{filler}\nask jane@x.org or Jane@x.org {' '.join(r.choices(['Morvella', 'common', 'Quazzelhof'], k=2))}\n{filler} yours Quazzelhof" for _ in range(6)]
    texts += [f"{filler} common bob@mail.example {r.choice(['Tarnwick', 'Morvella', 'other'])}" for _ in range(9)] + [filler + " common"] * 100 + ["Quazzelhof was here"]
    docs = table(spark, texts + texts[:2], [*range(len(texts)), 0, 1])        # repeated rows are one document
    got = {x["doc_id"]: x for x in disclosure.disclosure_report(docs).collect()}
    want = brute_terms(dict(enumerate(texts)))
    spans = {i: [(int(a), int(b)) for k, a, b in (s.split(":") for s in x["spans"].split(",") if s) if k == "term"] for i, x in got.items()}
    assert spans == want and len(want[0]) >= 2 and want[len(texts) - 1] == []
    clean = {x["doc_id"]: x["text"] for x in disclosure.sanitised(docs).collect()}
    assert not any("Quazzelhof" in clean[i] for i in range(6)) and clean[len(texts) - 1] == texts[-1]


def test_terms_at_the_edges_of_a_text(spark):
    texts = ["Jonathan jon@x.org", "jon@x.org Jonathan", "Jonathan, jon@x.org"] + ["plain words that name nobody"] * 60
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitised(table(spark, texts)).collect()}
    assert [clean[i] for i in range(4)] == [" [EMAIL]", "[EMAIL] ", ", [EMAIL]", texts[3]]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = [*EDGES, *prose(21, 80, 70)]
    texts += [t + " tail" for t in texts[-20:]] + ["too short"]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    first, lines, unique, mixed, packed = seen
    assert len(texts) - 1 not in first and lines == first and len(unique) < len(lines) and mixed <= unique and packed == mixed


def test_sequences_follow_the_training_order(spark, tmp_path):
    import corpus_pipeline

    texts = [t for i, n in enumerate((400, 30, 30)) for t in prose(40 + i, n, 60)]
    docs = table(spark, texts).withColumn("source", F.when(F.col("doc_id") < 400, "big").when(F.col("doc_id") < 430, "a").otherwise("c"))
    mixing.curriculum(docs).write.parquet(f"{tmp_path}/mixed")
    order = [r["doc_id"] for r in mixing.curriculum(docs).collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = corpus_pipeline.training_sequences(spark, spark.read.parquet(f"{tmp_path}/mixed"), str(tmp_path)).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ranges: dict = {}
    for r in rows:
        if r["start"] == 0:
            ranges.setdefault((r["sequence_id"] >> 40, r["step_group"] >> 40), []).append(r["doc_id"])
    assert len(ranges) > 1 and sum(map(len, ranges.values())) == len(order) and max(Counter(order).values()) > 1
    at = 0
    for _, ids in sorted(ranges.items()):
        assert sorted(ids) == sorted(order[at:at + len(ids)])
        at += len(ids)
    assert max(Counter((r["sequence_id"], r["doc_id"]) for r in rows if r["start"] == 0).values()) == 1


def test_the_distance_alone_rejects_by_each_statistic(spark):
    clean = prose(50, 200, 100)
    words = prose(51, 4, 100)
    lines = [" ".join(w) for w in zip(*[iter(words[0].split())] * 4, strict=False)]
    odd = {"length": " ".join(w * 4 for w in words[1].split()), "symbols": words[2].replace(" ", " # & "),
           "repeats": words[3] + " " + " ".join(words[3].split()[:9]), "lines": "\n".join(f"{x}\nyes" for x in lines)}
    texts = clean + list(odd.values())
    got = {x["doc_id"]: x for x in quality.document_quality(table(spark, texts).withColumns({"lang": F.lit("en"), "source": F.lit("s")})).collect()}
    for i, name in enumerate(odd, len(clean)):
        assert not got[i]["base_failed"] and not got[i]["kept"], (name, got[i])
    assert all(got[i]["kept"] for i in range(len(clean)))


def test_near_duplicates_are_told_by_id_and_text(spark):
    t, u, s, other, much = prose(70, 5)
    near = t + " tail"
    rows = [(3, t), (5, t), (5, u), (1, s), (1, s), (2, s), (None, s), (None, other), (None, other + " tail"), (None, "alone in the world without any id"), (8, near), (8, u + " " + much),
            (9, ""), (9, ""), (None, None)]
    docs = table(spark, [x for _, x in rows], [i for i, _ in rows])
    kept = sorted(((r["doc_id"], r["text"]) for r in ngramjoin.drop_near_duplicates(docs).collect()), key=str)
    assert len(kept) == 9 and set(kept) - {(None, other), (None, other + " tail")} == {(3, t), (5, u), (1, s), (None, "alone in the world without any id"), (8, u + " " + much), (9, ""), (None, None)}


def test_unknown_lines_are_refused():
    shard = linededup.Shard()
    keys = np.array([(1, 1), (1, 2), (5, 0)], linededup.Shard.KEY)
    shard.insert(keys, np.array([2, 1, 3]), np.array([4, 5, 6]))
    for bad, n in (((1, 3), 1), ((9, 9), 1), ((1, 2), 2)):
        with pytest.raises(ValueError, match="never counted"):
            shard.remove(np.array([(1, 1), bad], linededup.Shard.KEY), np.array([1, n]), np.array([9, 9]))
        assert shard.refs.tolist() == [2, 1, 3] and shard.filter.contains(keys["a"]).all()


def test_a_table_may_have_the_planted_conversation(spark):
    schema = "conv_id long, turn long, role string, text string"
    long_text = "word & <|im_sep|> " * 50_000
    rows = [(-1, 0, "user", "mine"), (-1, 1, "assistant", long_text), (3, 0, None, None)]
    got = sorted((r["conv_id"], r["n_turns"], r["loss_chars"]) for r in chat.chat_report(spark, spark.createDataFrame(rows, schema)).collect())
    planted = len("<|im_end|><|im_start|>assistant ok")
    assert got == [(-1, 2, planted), (-1, 2, len(long_text)), (3, 1, 0)]
    assert [r["conv_id"] for r in chat.chat_report(spark, spark.createDataFrame([], schema)).collect()] == [-1]


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text: str) -> list[str]:
    def real(kind, value):
        digits = [int(c) for c in value if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            twice = [d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text) if real(k, m.group())]


def test_personal_data_is_what_the_patterns_say(spark):
    hostile = ["a@b.c a@b a@b.c.d. .x@y.zz@q.rr %@-.- é.a@ö.de", "1.2.3.4.5.6.7.8 256.1.1.1 1.256.1.1 01.002.3.255 1.2.3 99999999999999999999.1.1.1",
               "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 0000000000000 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 4111  1111", "+1 (202) 555-0175 +12 +1..........2 ++49 30 1234567 +1-2-3-4-5-6-7-8-9",
               "x" * 5000 + "@" + "y" * 3000 + ".z", "1" * 4000, "😀 me@x.org 😀 10.0.0.1 😀 +49 170 1234567", "a@b.c" * 50, "5500005555555559 5500005555555559"]
    texts = [*EDGES, *hostile, *prose(31, 10)]
    for r in disclosure.disclosure_report(table(spark, texts)).collect():
        want = brute_pii(texts[r["doc_id"]] or "")
        assert {k: r[f"n_{k}"] for k in PII} == {k: sum(s.startswith(k) for s in want) for k in PII}, texts[r["doc_id"]][:60]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term")] == want


def test_positions_invert_the_integrated_schedule(spark):
    """_time against a numerical integral of the schedule."""
    shares = np.linspace(0, 1, 41)
    rows = spark.createDataFrame([(float(s), k) for s in shares for k in range(len(mixing.SCHEDULES))], "s double, rank int")
    fine = np.linspace(0, 1, 20_001)
    for r in rows.select("*", mixing._time(F.col("s"), F.col("rank")).alias("t")).collect():
        weight = np.interp(fine, np.linspace(0, 1, len(mixing.SCHEDULES[r["rank"]])), mixing.SCHEDULES[r["rank"]])
        reached = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        assert abs(np.interp(r["t"], fine, reached / reached[-1]) - r["s"]) < 1e-6
    docs = table(spark, prose(60, 400, 30))
    first = {r["doc_id"]: (r["positions"], r["taken"]) for r in mixing.mixture(docs).collect()}
    order = [r["doc_id"] for r in mixing.curriculum(docs).collect()]
    assert order == [i for _, i in sorted((p, i) for i, (ps, _) in first.items() for p in ps)]


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """run() against plain Python, each stage on what the one before has left; the mix and the tokenizer are asked by document."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    base, tokenizer = prose(81, 60, 70), Tokenizer.from_file(packing.public_tokenizer())
    texts = [*EDGES, *base, *(t + " tail" for t in base[:10]), *base[:5], "too short", "same " * 40]
    texts += [f"{t}\nthis line stands in several documents\nown line number {k}" for k, t in enumerate(prose(82, 12, 50))]
    table(spark, texts, [*range(len(texts) - 2), 3, None]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)
    judged = {(r["doc_id"], r["n_words"], r["word_chars"]): r["kept"] for r in quality.document_quality(docs).collect()}
    words = lambda t: WORD.findall(t or "")
    good = [(i, t) for i, t in rows(docs) if judged[i, len(words(t)), sum(map(len, words(t)))]]
    stages, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        stages[name] = at = spark.read.parquet(f"{tmp_path}/{name}")
    assert rows(stages["quality"]) == sorted(good, key=str) and len(good) < len(texts)
    held = {k: t for k, (_, t) in enumerate(sorted(good, key=lambda g: (g[0] is None, g[0] or 0)))}      # a null id is the largest
    cleaned = brute_lines(held)
    names = sorted(good, key=lambda g: (g[0] is None, g[0] or 0))
    lines = [(names[k][0], "\n".join(v)) for k, v in cleaned.items()]
    assert rows(stages["lines"]) == sorted(lines, key=str)
    links = brute_links(dict(enumerate(t for _, t in lines)))
    unique = [g for k, g in enumerate(lines) if links[k][1] == k]
    assert rows(stages["near_duplicates"]) == sorted(unique, key=str) and len(unique) < len(lines)
    copies = Counter()
    for r in mixing.mixture(stages["near_duplicates"]).collect():
        copies[r["doc_id"]] += len(r["positions"])
    assert Counter(i for i, _ in rows(stages["mixing"])) == +copies
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    seen: dict = {}
    for r in ran:
        seen.setdefault(r["doc_id"], []).append(r)
    assert {i: sum(r["start"] == 0 for r in x) for i, x in seen.items()} == dict(+copies)
    for i, text in unique:
        own = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert sum(r["length"] for r in seen.get(i, [])) == copies[i] * len(own)
        assert all(list(r["ids"]) == own[r["start"]:r["start"] + r["length"]] for r in seen.get(i, []))


def _packets(pid: int, section: bytes, pointer: int = 0, counter: int = 0, tail: bytes = b"") -> bytes:
    """Transport packets of a section that starts after ``pointer`` bytes of stuffing."""
    body, out = bytes([pointer]) + b"\xff" * pointer + section + tail, b""
    for k, at in enumerate(range(0, len(body), 184)):
        head = bytes([0x47, (0x40 if k == 0 else 0) | pid >> 8, pid & 0xFF, 0x10 | (counter + k) & 15])
        out += head + body[at:at + 184].ljust(184, b"\xff")
    return out


def _sealed(table: int, number: int, body: bytes, version: int = 0) -> bytes:
    raw = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1 | version << 1, 0, 0]) + body
    return raw + transport.checksum(raw).to_bytes(4, "big")


def test_tables_over_several_packets():
    payload = transport.padded(random.Random(4).randbytes(5000))
    whole = transport.write_stream(payload)
    pat, units, pid = whole[:188], whole[376:], transport.PMT_PID
    # a map of one program whose descriptors take 600 bytes, so four packets
    long_map = _sealed(2, 1, (0xE100).to_bytes(2, "big") + (0xF000 | 600).to_bytes(2, "big") + bytes(600) + b"\x06" + (0xE100).to_bytes(2, "big") + b"\xf0\x00")
    stream = _packets(pid, long_map)
    assert len(stream) == 4 * 188
    for first in (stream, _packets(pid, long_map, pointer=90), stream[:188] + stream):     # a start that was broken off is begun again
        got = transport.read_stream(pat + first + units)
        assert got["payload"] == payload and got["errors"] == 0
    lost = transport.read_stream(pat + stream[:188] + stream[376:] + units)
    assert lost["payload"] == b"" and lost["errors"] == 1       # the map is missing, which is told
    # two sections in one packet, of which the second is of another program's map, and a later version that counts
    other = _sealed(2, 2, (0xE200).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE200).to_bytes(2, "big") + b"\xf0\x00")
    old = _sealed(2, 1, (0xE100).to_bytes(2, "big") + b"\xf0\x00", 3)
    new = _sealed(2, 1, (0xE100).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE100).to_bytes(2, "big") + b"\xf0\x00", 4)
    got = transport.read_stream(pat + _packets(pid, other, tail=old) + _packets(pid, new, counter=1) + units)
    assert got["payload"] == payload and got["errors"] == 0


def test_repeated_packets_must_be_equal():
    payload = transport.padded(random.Random(6).randbytes(3000))
    whole = transport.write_stream(payload)
    packet = [whole[i:i + 188] for i in range(0, len(whole), 188)]
    assert transport.read_stream(b"".join([*packet[:5], packet[4], *packet[5:]])) | {"packets": 0} == transport.read_stream(whole) | {"packets": 0}
    changed = packet[4][:100] + b"\x00" + packet[4][101:] if packet[4][100] else packet[4][:100] + b"\x01" + packet[4][101:]
    assert transport.read_stream(b"".join([*packet[:5], changed, *packet[5:]]))["errors"] > 0
    assert transport.read_stream(b"".join([*packet[:5], packet[4], packet[4], *packet[5:]]))["errors"] > 0      # one repetition is allowed
    # a marked jump of the counter is no gap
    two = transport.write_stream(transport.padded(bytes(transport.UNIT + 64)))
    unit = 376 + 188 * -(-(transport.UNIT + 14 + 8) // 184)
    last = bytearray(two[unit:])
    assert last[1] & 0x40 and len(last) == 188
    last[3] = last[3] & 0xF0 | (last[3] + 5) & 15
    assert transport.read_stream(two[:unit] + bytes(last))["errors"] == 1
    last[5] |= 0x80
    assert transport.read_stream(two[:unit] + bytes(last))["errors"] == 0


def test_media_report_by_hand(spark):
    texts = [*EDGES, *prose(8, 5, 9000)]
    for r in transport.media_report(table(spark, texts)).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        kept = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = transport.write_stream(kept)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(kept), hashlib.sha256(kept).hexdigest(), zlib.crc32(kept[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        units = -(-len(kept) // transport.UNIT)
        assert r["feature"] == f"packets={len(media) // 188};units={units};random={-(-units // 4)};last={(units - 1) * 3600};errors=0"
