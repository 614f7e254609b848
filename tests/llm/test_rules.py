"""Cases that the wider tests of test_text.py do not reach: tight quotas, spellings of one value, null and odd ids."""

import itertools
import random
from collections import Counter

import pytest
from conftest import words

from tapeline.llm import jaccard, pseudonyms, sharding, substrings


# -- sharding ---------------------------------------------------------------------------------------------------------
def least_splits(groups, quota):
    """Brute force: fewest groups that cannot be whole, over all placements of the whole ones (singles fill the rest)."""
    best = len(groups)
    for places in itertools.product(range(-1, len(quota)), repeat=len(groups)):
        loads = Counter()
        for g, s in zip(groups, places, strict=True):
            loads[s] += g if s >= 0 else 0
        if all(loads[s] <= q for s, q in enumerate(quota)):
            best = min(best, places.count(-1))
    return best


def quota_of(total, shards):
    return [total // shards + (s < total % shards) for s in range(shards)]


@pytest.mark.parametrize("seed", range(6))
def test_dealing_is_near_brute_force(seed):
    r = random.Random(seed)
    groups = [r.choice([2, 2, 3, 4, 6]) for _ in range(7)]
    quota = quota_of(sum(groups) + r.choice([0, 3]), 3)
    places, splits = sharding.deal(sorted(Counter(groups).items()), quota)
    loads = [sum(z * p[s] for z, p in places.items()) + sum(n for _, _, t, n in splits if t == s) for s in range(3)]
    assert all(a <= b for a, b in zip(loads, quota, strict=True)) and sum(loads) == sum(groups)
    assert len({(z, k) for z, k, _, _ in splits}) <= least_splits(groups, quota) + 1


@pytest.mark.parametrize(("sizes", "singles", "most"), [([2] * 480, 0, 0), ([4] * 225, 60, 0), ([3] * 100 + [2] * 30, 0, 2), ([2] * 492, 0, 12)])
def test_full_shards_split_no_more_than_they_must(docs, sizes, singles, most):
    texts = [f"g{i}" for i, n in enumerate(sizes) for _ in range(n)] + [f"single {i}" for i in range(singles)]
    got = sharding.shard_documents(docs(*texts)).toPandas()
    counts = got.groupby("shard").size()
    assert len(counts) == 24 and counts.max() - counts.min() <= 1
    split = got.groupby("text_crc32")["shard"].nunique()
    assert (split > 1).sum() <= most


def cells_of(spark, rows):
    return spark.createDataFrame([(f"{t:04d}".encode(), s, n) for t, s, n in rows], "text binary, shard int, n long").repartition(3)


def test_propagation_exchanges_between_full_shards(spark):
    # every text lies in two of four shards, all of which are full
    rows = []
    for t in range(40):
        a, b = (t % 4, (t + 1 + t // 20) % 4)
        rows += [(t, a, 3), (t, b, 1 + t % 2)]
    quota = [sum(n for _, s, n in rows if s == k) for k in range(4)]
    got = sharding.propagate(cells_of(spark, rows), quota).collect()
    totals, loads = Counter(), Counter()
    for x in got:
        totals[x.text] += x.n
        loads[x.shard] += x.n
    assert all(loads[k] <= quota[k] for k in range(4)) and sum(totals.values()) == sum(quota) and len(totals) == 40
    cut = sum(1 for n in Counter(x.text for x in got).values() if n > 1)
    assert cut <= 8
    # one row of a text is alone; a whole text of one row can go the other way, or one of the same size
    swap = [(0, 0, 2), (0, 1, 1), (1, 0, 1), (2, 1, 2)]
    got = sharding.propagate(cells_of(spark, swap), [3, 3]).collect()
    assert sorted((x.text, x.shard) for x in got if x.text == b"0000") == [(b"0000", 0)] and len(got) == 3


def test_sharding_with_odd_ids_and_columns(spark):
    rows = [(None, "a", 1), (None, "a", 2), ("x", None, 3), ("x", "", 4), ("x", "", 4)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id string, text string, shard int"), shards=2).toPandas()
    assert len(got) == 5 and sorted(got.groupby("shard").size()) == [2, 3]


# -- pseudonyms -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "spellings",
    [
        ["+1 202 555 0101", "+12025550101", "+1-202-555-0101", "+1 (202) 555-0101"], ["+49 89 1234567", "+49891234567", "+49 (0)89 1234567"], ["+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958"],
        ["+353 1 234 5678", "+35312345678"], ["(202) 555-0101", "202-555-0101", "202.555.0101"], ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"], ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
    ],
)
def test_spellings_of_a_value_share_a_pseudonym(spellings):
    p, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", -1)
    said = [p.replace(f"at {s} now")[0] for s in spellings]
    assert len({"".join(c for c in x.replace("(0)", "") if c.isalnum()) for x in said}) == 1
    for s, x in zip(spellings, said, strict=True):
        assert [c for c in x if not c.isalnum()] == [c for c in f"at {s} now" if not c.isalnum()] and x != f"at {s} now"
        assert back.replace(x)[0] == f"at {s} now"
    # in North America the country code is no part of the number
    digits = lambda x: "".join(c for c in x if c.isdigit())
    assert digits(p.replace("+1 202 555 0101")[0])[1:] == digits(p.replace("(202) 555-0101")[0])


def test_each_day_has_one_pseudonym_in_all_its_writings():
    p, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", -1)
    seen = set()
    for n in range(0, 73_049, 97):
        d = pseudonyms.dt.date.fromordinal(pseudonyms._DAY0 + n)
        forms = [d.isoformat(), f"{d.day:02d}/{d.month:02d}/{d.year}", f"{d.day}.{d.month}.{d.year}", f"{d.year}/{d.month}/{d.day}"]
        if d.day > 12:
            forms += [f"{d.month:02d}/{d.day:02d}/{d.year}", f"{d.month}/{d.day}/{d.year}"]
        new = [p.replace(f)[0] for f in forms]
        y, m, dd = (int(x) for x in new[0].split("-"))
        seen.add((y, m, dd))
        want = [(y, m, dd), (dd, m, y), (dd, m, y), (y, m, dd), (m, dd, y), (m, dd, y)]
        assert [tuple(int(x) for x in pseudonyms.regex.split("[-/.]", f)) for f in new] == want[: len(new)]
        assert [len(a) for a in new] == [len(f) for f in forms]
        assert [back.replace(x)[0] for x in new] == forms
    assert len(seen) == len(range(0, 73_049, 97))


def test_key_comes_from_the_session_or_is_drawn(spark):
    drawn = pseudonyms.secret_key(spark)
    assert len(drawn) == 32 and pseudonyms.secret_key(spark) == drawn
    spark.conf.set(pseudonyms.KEY_SETTING, "mine")
    try:
        assert pseudonyms.secret_key(spark) == b"mine"
    finally:
        spark.conf.unset(pseudonyms.KEY_SETTING)
    with pytest.raises(ValueError, match="key"):
        pseudonyms.Pseudonyms(b"")


# -- ids --------------------------------------------------------------------------------------------------------------
def test_null_and_negative_ids_are_told_apart(spark):
    r = random.Random(3)
    a, b, c = words(r, 60), words(r, 60), words(r, 60)
    rows = [(-1, a, 1), (None, b, 2), (0, c, 3), (None, c, 4), (7, a, 5), (None, words(r, 60), 6), (None, None, 7), (-1, words(r, 60), 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.similarity_classes(df).collect()), key=str)
    assert got == sorted([(-1, 57, -1), (None, 57, None), (0, 57, 0), (None, 57, 0), (7, 57, -1), (None, 57, None), (None, 0, None), (-1, 57, -1)], key=str)
    cut = sorted(((x.doc_id, x.n_words, x.n_removed) for x in substrings.cut_repeats(df).collect()), key=str)
    assert cut == sorted([(-1, 60, 60), (None, 60, 0), (0, 60, 60), (None, 60, 60), (7, 60, 60), (None, 60, 0), (None, 0, 0), (-1, 60, 0)], key=str)
    named = df.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert sorted((str(x.doc_id), x.n_removed) for x in substrings.cut_repeats(named).collect()) == sorted((str(i), n) for i, _, n in cut)
    assert jaccard.similarity_classes(df.limit(0)).count() == 0 and substrings.cut_repeats(df.limit(0)).count() == 0
    kept = sorted(x.row for x in jaccard.keep_one(df).collect())
    assert kept == [1, 2, 4, 6, 7, 8]


# -- search -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("dims", "block", "query"), [(384, 1 << 16, 1 << 13), (64, 40, 3), (20, 40, 3)])
def test_search_of_any_dimension(spark, monkeypatch, dims, block, query):
    from tapeline.llm import hamming

    monkeypatch.setattr(hamming, "INDEX_BLOCK", block)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", query)
    r = random.Random(dims)
    base = [[r.choice([-1.0, 1.0]) for _ in range(dims)] for _ in range(12)]
    near = lambda v: [-x if r.random() < 0.1 else x for x in v]
    rows = [(i, near(base[i % 12]) if i % 3 else base[i % 12] if i % 2 else [r.gauss(0, 1) for _ in range(dims)]) for i in range(260)]
    rows += [(300, base[0][: dims // 2]), (320, []), (None, base[1]), (340, None), (360, [None] * dims), (380, [0.0] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    codes = {i: tuple(x > 0 for x in v) + (False,) * (dims - len(v)) for i, v in rows if i is not None and v is not None and None not in v}
    want = set()
    for q in (i for i in codes if i % 20 == 0):
        order = sorted((sum(a != b for a, b in zip(codes[q], codes[o], strict=True)), o) for o in codes if o != q)[:10]
        want |= {(q, k + 1, o, d) for k, (d, o) in enumerate(order)}
    assert {tuple(x) for x in hamming.nearest_report(df).collect()} == want
    assert hamming.nearest_report(df.limit(0)).count() == 0


# -- tokenizer files --------------------------------------------------------------------------------------------------
def small_file(**more):
    import json

    vocab = {c: 200_000 + i for i, c in enumerate("abcdĠ")}
    merges = [("a", "b"), ("ab", "a"), ("b", "a"), ("a", "a"), ("aba", "b"), ("Ġ", "a"), ("c", "d"), ("aba", "aba"), ("aa", "b")]
    for x, y in merges:
        vocab.setdefault(x + y, 200_000 + len(vocab))
    model = {"type": "BPE", "vocab": vocab, "merges": [f"{x} {y}" for x, y in merges]} | more.pop("model", {})
    base = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None} | base | more | {"model": model})


@pytest.mark.parametrize("row", [1, 2, 48])
@pytest.mark.parametrize(
    "more",
    [{}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
     {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "c+|[ab]{1,5}"}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}],
)
def test_large_ids_and_settings_equal_the_library(monkeypatch, more, row):
    from tokenizers import Tokenizer

    from tapeline.llm import bpe

    monkeypatch.setattr(bpe, "ROW", row)
    spec = small_file(**more)
    lib, own = Tokenizer.from_str(spec), bpe.Automaton(spec)
    r = random.Random(1)
    for text in ["", "a", " ab", *("".join(r.choice("aaabbbcd ") for _ in range(r.randint(1, 40))) for _ in range(300))]:
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(
    "more",
    [{"normalizer": {"type": "Lowercase"}}, {"model": {"ignore_merges": True}}, {"model": {"end_of_word_suffix": "</w>"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "WordPiece"}},
     {"added_tokens": [{"id": 9, "content": "<x>", "single_word": False, "lstrip": True, "rstrip": False, "normalized": False, "special": True}]}],
)
def test_unknown_settings_are_refused(more):
    from tapeline.llm import bpe

    with pytest.raises(ValueError, match="not supported"):
        bpe.Automaton(small_file(**more))


def test_decontamination_in_shards_and_pieces(docs, spark, monkeypatch):
    """Long items in pieces, many shards, repeated rows, null ids, columns with clashing names and maps."""
    from pyspark.sql import functions as F

    from tapeline.llm import decontaminate as D

    r = random.Random(2)
    long, short = words(r, 300), "tiny item here"
    bench = spark.createDataFrame([("l", long), ("s", short), (None, words(r, 30)), ("e", ""), ("n", None), ("s2", short)], "item_id string, text string")
    part = " ".join(long.split()[95:130])
    df = docs("x " + part, part, part, "A Tiny, item HERE!", None, "", words(r, 50)).withColumn("hits", F.lit(3)).withColumn("_row", F.create_map(F.lit("a"), F.lit(1)))
    want = sorted(map(str, D.leak_report(df.drop("_row", "hits"), bench).collect()))
    assert [x.split("n_hit=")[1].split(",")[0] for x in want] == ["35", "35", "35", "3", "0", "0", "0"]
    monkeypatch.setattr(D, "PIECE", 40)
    assert sorted(map(str, (x for x in D.find_leaks(df.drop("_row", "hits"), bench, shard_bytes=300).select("doc_id", "n_words", F.size("hits").alias("n"), "items").collect()))) == sorted(
        map(str, D.find_leaks(df.drop("_row", "hits"), bench).select("doc_id", "n_words", F.size("hits").alias("n"), "items").collect()))
    kept = D.drop_leaks(df, bench)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [4, 5, 6]
    assert D.leak_report(docs("a").limit(0), bench).count() == 0 and D.leak_report(df.drop("_row"), bench.limit(0)).filter("contaminated").count() == 0
