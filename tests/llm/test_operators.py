"""The other operators against brute force, on made rows with nulls, ties, repeats, long texts and clashing columns, and on a small table."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from siftflow.llm import bpe, common, decontamination, exact_dedup, license_scan, line_dedup, quality, queries, simhash, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return [w.decode() for w in WORD.findall((t or "").encode().lower())]


def frame(spark, rows, extra="kept string, n_words string, w string, l string, text_sha256 string"):
    n = len(extra.split(","))
    return spark.createDataFrame([(d, t, *["x"] * n) for d, t in rows], f"doc_id long, text string, {extra}").repartition(3)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = [(900, None), (901, ""), (902, "   \n\n "), (None, "one two three\nfour\nfive\nsix"), (None, None), (903, "ÀÉ İstanbul ΣΑΣ Mit-License x"), (904, "a b c " * 20_000)]


# ---------------------------------------------------------------- quality


def test_quality_held_out(spark):
    df = queries.op1_quality_classifier(spark, "/root/testdata/sf0.01")
    got = {r.doc_id: r for r in df.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    held = [(r.predicted, labels[d]) for d, r in got.items() if r.held_out and d in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_quality_odd(spark):
    docs = frame(spark, [*ODD, (901, "x y z"), (1, "good prose here, and more of it."), (2, "BAD!! BAD!! BAD!!")])
    labels = spark.createDataFrame([(1, 1, "t"), (1, 1, "t"), (2, 0, "t"), (None, 1, "t"), (900, None, "t"), (77, 1, "t")], "doc_id long, quality int, text string")
    got = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (1, 2)} == {1: 1, 2: 0}
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), none).collect() == []


def test_quality_votes_match_brute_force():
    import numpy as np

    r = np.random.default_rng(3)
    counts, y = r.integers(0, 9, (60, quality.COLUMNS)).astype(float), r.integers(0, 2, 60)
    m = quality.Model(counts, y, np.ones(quality.COLUMNS, np.float32), neighbours=5)
    v = quality.unit(quality.weighed(counts[:7], m.idf) @ m.map)
    for got, x in zip(m.score(counts[:7]), v):
        sims = sorted(((max(float(x @ z), 0) ** m.power, t) for z, t in zip(m.vectors, y)), reverse=True)[:5]
        assert got == pytest.approx(sum(s * t for s, t in sims) / sum(s for s, _ in sims), rel=1e-4)


# ---------------------------------------------------------------- lines


def brute_lines(rows):
    first = {}
    split = [(d, t.split("\n") if t is not None else []) for d, t in rows]
    for d, ls in split:
        for i in range(len(ls) - 2) if d is not None else ():
            k = tuple(ls[i : i + 3])
            first[k] = min(first.get(k, (d, i)), (d, i))
    for d, ls in split:
        drop = {j for i in range(len(ls) - 2) if d is not None and first[tuple(ls[i : i + 3])] < (d, i) for j in (i, i + 1, i + 2)}
        yield d, "\n".join(x for j, x in enumerate(ls) if j not in drop), len(ls), len(drop)


def test_lines(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choices("abc", k=r.randrange(0, 14)))) for i in range(60)] + ODD + [(1000, "q\n" * 3000)]
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert Counter(tuple(x) for x in got.collect()) == Counter(brute_lines(rows))
    same = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")]
    assert sorted(tuple(x) for x in line_dedup.dedup_lines(frame(spark, same)).collect()) == [(1, "a\nb\nc", 3, 0), (1, "a\nb\nc", 3, 0), (2, "d", 4, 3)]
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).collect() == []


# ---------------------------------------------------------------- BPE


def test_bpe(spark):
    rows = [*ODD, (1, "It's NOT 12 o'clock, <|endoftext|> isn't it?!"), (1, "It's NOT"), (2, "e\u0301 ﬁ ǅ Ⅷ 한국어 \u3000x\x1cy\x85z\xa0w"), (3, "<|STARTOFTEXT|> <|startoftext|>abc 'S 'll ''s"), (4, "🙂🙂 \u200d \u0345ΑΣ")]
    rows += [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").limit(60).collect()]
    t = bpe.tokenizer(queries.vocabulary())
    want = Counter()
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[d, len(ids), struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False)] += 1
    for chunk in (100, 1 << 21):
        got = bpe.encode_decode(frame(spark, rows, "ids string, chunk string"), queries.vocabulary(), chunk_words=chunk)
        assert Counter((d, n, bytes(i), x) for d, n, i, x in got.collect()) == want
    assert bpe.encode_decode(frame(spark, rows).limit(0), queries.vocabulary()).collect() == []


def test_bpe_splits_every_plain_character_as_the_library():
    s = bpe.Splitter(queries.vocabulary())
    ids = lambda t: s.lib.encode(t, add_special_tokens=False).ids
    for c in map(chr, [*range(1, 0x300), 0x3A3, 0x3C2, 0x1E9E, 0x2C65, 0x4E00, 0xAC00, 0x1F642]):
        for t in (c, f"a{c}b", f"1{c}'s{c}!", c * 3, f"{c}\u0301"):
            assert ids(t) == [i for w in s(t) for i in ids(w)], hex(ord(c))


# ---------------------------------------------------------------- URLs


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].encode().lower().decode() if rest[:cut].isascii() else "".join(c.lower() if c.isascii() else c for c in rest[:cut]), re.split("[?#]", rest[cut:])[0]
    fits = [(len(h + p), h + p, v) for h, p, _, _, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    spam = re.search(r"(^|[.-])(spam|casino)([.-]|\Z)|(^|\.)(cheap|online|best)-pills([.-]|\Z)", host)
    return (host, path, *(max(fits)[1:] if fits else (None, "block" if spam else "allow")))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/", "http://Example.com/en/1", "https://www.EXAMPLE.com/en/", "http://xexample.com/en/", "http://a.net/es/x?y", "http://net/fr", "http://net/fr/#a", "ftp://a.b.net/fr/\nx", "http://é.COM/en/", "http://example.com?/en/", "x://y://example.com/en/", "http://example.com:80/en/", "http://www.example.com/es/", "http://com", "http://spam-farm.org/x", "http://a.SPAM.org", "http://www.cheap-pills.de?x", "http://spammer.org/", "http://x.org/spam", "http://spam.com/y", "http://big-casino"]
    urls += ["http://example.com\n/en/x", "http://x\n.example.com/en/1", "http://a\nb.com/", "http://www.example.com\r\n/en/", "http://\nnet/fr/", "http://spam\n", "http://a\n.spam/x", "http://ok.org/?u=http://spam.org/", "http://a.com.net/es/\n"]
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)] + [(5, urls[5], "x", "y"), (None, urls[5], "", ""), (None, None, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    assert Counter(tuple(x) for x in url_filter.url_verdicts(df).collect()) == Counter((i, *brute_url(u)) for i, u, *_ in rows)
    assert url_filter.url_verdicts(df.limit(0)).collect() == []
    rules = spark.createDataFrame([("", "", "utm_", None, "block"), ("shop.com", "/a", r"[0-9]{3}$", None, "block"), (None, "/ok/", None, None, "allow")], url_filter.RULE_SCHEMA)
    some = spark.createDataFrame([(1, "http://x.shop.com/abc/123"), (2, "http://shop.com/abc/12"), (3, "http://q/?utm_x"), (4, "http://q/ok/?utm_x")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(some, rules).collect()} == {1: ("shop.com/a", "block"), 2: (None, "allow"), 3: (None, "block"), 4: ("/ok/", "allow")}


# ---------------------------------------------------------------- decontamination


def brute_hits(rows, items):
    wins = {}
    for item, t in items:
        w = words(t)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[k]
        yield d, len(w), len(hit), ",".join(sorted(found)), bool(hit)


def test_decontamination(spark):
    r = random.Random(9)
    vocab = ["alpha", "Beta", "gamma-", "é2", "of", "of", "of", "the"]
    text = lambda k: " ".join(r.choices(vocab, k=k))
    items = [(i, text(r.choice([0, 1, 2, 5, 12, 20]))) for i in range(14)] + [(3, "of"), (50, None), (51, "zeta never")]
    rows = [(i, text(20) + " " + (r.choice(items)[1] or "") + " " + text(5)) for i in range(50)] + ODD + [(7, text(9))]
    item_df = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, phrase string")
    got = decontamination.contamination(frame(spark, rows, "maybe string, hits string"), item_df)
    assert Counter((d, n, h, ",".join(i), c) for d, n, h, i, c in got.collect()) == Counter(brute_hits(rows, items))
    assert all(x.n_hit == 0 for x in decontamination.contamination(frame(spark, rows), item_df.limit(0)).collect())
    assert decontamination.contamination(frame(spark, rows).limit(0), item_df).collect() == []


def test_folding_changes_a_to_z_only(spark):
    chars = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    texts = chars.select(F.concat(F.lit("Az"), "c", F.lit("ZQ "), "c", "c").alias("t"))
    by_pattern = F.trim(F.regexp_replace(F.translate("t", common.UPPER, common.LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    assert texts.where(F.array_join(common.word_array(F.col("t")), " ") != by_pattern).collect() == []


@pytest.mark.parametrize("odd", ["\u2163", "\u24b6", "\u2c2f"])  # a Roman numeral, a circled capital, a capital newer than the JVM's Unicode
def test_decontamination_folds_a_word_alike_in_any_text(spark, odd):
    passage = f"Chapter {odd} mundi"
    items = spark.createDataFrame([(1, passage), (2, f"{passage} \u00c9")], "item_id long, text string")
    rows = [(1, f"x {passage} \u00c9"), (2, f"x {passage} y"), (3, "x mundi \u00c9")]
    got = decontamination.contamination(frame(spark, rows), items)
    assert Counter((d, n, h, ",".join(i), c) for d, n, h, i, c in got.collect()) == Counter(brute_hits(rows, [(1, passage), (2, f"{passage} \u00c9")]))


def test_proximity(spark):
    docs = frame(spark, [(1, "rare " + "x " * 5 + "odd of"), (2, "rare " + "x " * 30 + "odd of"), (3, "x " * 17 + "odd x rare of"), (4, None)])
    items = spark.createDataFrame([(9, "odd rare")], "item_id long, text string")
    # a null id is a row like any other
    docs = docs.unionByName(frame(spark, [(None, "odd b c rare")]))
    got = decontamination.proximity_matches(docs, items, terms=2, slop=10).collect()
    assert Counter(tuple(x) for x in got) == Counter([("9", 1), ("9", 3), ("9", None)])
    docs = docs.where("doc_id IS NOT NULL")
    assert sorted(tuple(x) for x in decontamination.proximity_matches(docs, items, terms=2, slop=10).collect()) == [("9", 1), ("9", 3)]


# ---------------------------------------------------------------- exact dedup


def brute_exact(rows):
    norm = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest() for _, t in rows]
    for (d, _), h in zip(rows, norm):
        group = [(-len(t or ""), i is None, i) for (i, t), g in zip(rows, norm) if g == h]
        keep = min(group, key=lambda g: (g[0], g[1], g[2] or 0))[2]
        yield d, keep, len(group), d == keep, h


@pytest.mark.parametrize("most", [1, 1 << 20])  # a filter that lets nearly all rows pass, and one that fits
def test_exact(spark, most, monkeypatch):
    monkeypatch.setattr(common, "FILTER_ROWS", most)
    r = random.Random(2)
    rows = [(i, "".join(r.choices("ab \n\u00a0", k=r.randrange(0, 5)))) for i in range(80)] + ODD + [(5, "a b"), (5, "a b")]
    got = exact_dedup.dedup_exact(frame(spark, rows), hash_all=True).collect()
    assert Counter(tuple(x)[:5] for x in got) == Counter(brute_exact(rows)) and len({x.row for x in got}) == len(rows)
    lazy = exact_dedup.dedup_exact(frame(spark, rows)).collect()
    assert Counter(tuple(x)[:4] for x in lazy) == Counter(x[:4] for x in brute_exact(rows)) and any(x.full_hash is None for x in lazy)
    assert exact_dedup.dedup_exact(frame(spark, rows).limit(0)).collect() == []


def test_exact_hashes_only_survivors(spark, monkeypatch):
    seen = []
    whole = exact_dedup.hashed
    monkeypatch.setattr(exact_dedup, "hashed", lambda rows: seen.append(rows) or whole(rows))
    exact_dedup.dedup_exact(spark.createDataFrame([(i, f"text {i % 90:03} " * 50) for i in range(100)], "doc_id long, text string")).collect()
    assert len(seen) == 1 and seen[0].count() < 60  # twenty rows have a copy; the filter is of 64 bits a slot
    assert "Exchange hashpartitioning" not in seen[0]._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_parted_keeps_every_match(spark, most, monkeypatch):
    monkeypatch.setattr(common, "FILTER_ROWS", most)
    rows, keys = spark.range(3000).withColumnRenamed("id", "k"), common.written(spark.range(0, 3000, 7).withColumnRenamed("id", "k"), "keys")
    some, others = common.parted(rows, keys, "k")
    assert some.count() + others.count() == 3000 and others.join(keys, "k").count() == 0
    assert some.count() < 1200 or most == 1
    assert common.parted(rows, keys.limit(0), "k")[0].count() == 0


# ---------------------------------------------------------------- licenses


def brute_base(t):
    w, at = words(t), []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        at += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def test_licenses(spark):
    rows = ODD + [(1, "The MIT License. mit license; License MIT"), (2, "GNU general public license v3, Apache-License"), (3, "license"), (4, "public license general public License"), (5, "x y Licensed under CC BY-NC 4.0. z"), (5, "z")]
    rows += [(6, "foo " + license_scan.TEMPLATES[10][1].replace("binary", "binary code") + " bar"), (7, "Licensed under something else entirely"), (8, "\n".join(["Released under the MIT License."] * 40))]
    rows += LICENSE_ROWS
    got = license_scan.scan_licenses(frame(spark, rows)).collect()
    assert Counter(tuple(x)[:6] for x in got) == Counter((d, *brute_base(t)) for d, t in rows)
    assert Counter((x.doc_id, x.labels, round(x.score, 9)) for x in got) == Counter((d, *brute_labels(t)) for d, t in rows)
    labels = {x.doc_id: x.labels for x in got}
    assert (labels[1], labels[2], labels[3], labels[6], labels[7], labels[8]) == ("mit", "apache,gpl", "", "bsd", "", "mit")
    assert [labels[i] for i in (20, 21, 22, 23, 24, 25)] == ["mit", "mit", "isc,zlib", "", "gpl", "bsd"]
    score = {x.doc_id: x.score for x in got}
    assert score[7] == 0 and score[20] == 1 and score[23] == 0 and score[26] == license_scan.MENTION and 0.1 < score[21] < 0.6
    assert Counter(x.labels for x in got if x.doc_id == 5) == {"cc-by-nc": 1, "": 1}  # rows of one id are judged each for themselves
    assert license_scan.scan_licenses(frame(spark, rows).limit(0)).collect() == []


def license_rows():
    texts = {}
    for label, t in license_scan.TEMPLATES:
        texts.setdefault(label, t)
    mit = texts["mit"].split()
    return [
        (20, "Some project. " + texts["mit"]),
        (21, "tail of one: " + " ".join(mit[60:110])),  # without its opening
        (22, texts["zlib"].replace("this software", "this fine software") + " and then " + texts["isc"]),
        (23, " ".join(random.Random(1).sample(mit, len(mit)))),  # its words in another order
        (24, texts["gpl"]),
        (25, "\n".join("# " + " ".join(texts["bsd"].split()[i : i + 9]) for i in range(0, 300, 9))),
        (26, "not the mit license at all"),
        (None, "this is " + texts["unlicense"]),
    ]


LICENSE_ROWS = license_rows()


def brute_labels(t):
    """By every pair of equal trigrams, in plain loops."""
    w, k, found = words(t), license_scan.GRAM, [(0.0, None)]
    for label, text in license_scan.TEMPLATES:
        tw = words(text)
        at = {}
        for j in range(len(tw) - k + 1):
            at.setdefault(tuple(tw[j : j + k]), []).append(j)
        lines = {}
        for i in range(len(w) - k + 1):
            for j in at.get(tuple(w[i : i + k]), ()):
                lines.setdefault(i - j, []).append(i)
        chains, last = [], None
        for d in sorted(lines):
            if last is None or d - last > license_scan.DRIFT:
                chains.append([])
            chains[-1].append((d, lines[d]))
            last = d
        for c in chains:
            if max(max(p) for _, p in c) + k - min(min(p) for _, p in c) > license_scan.STRETCH * len(tw) + license_scan.DRIFT:
                c = [max(c, key=lambda x: (len({tuple(w[i : i + k]) for i in x[1]}), -min(x[1]), x[0]))]
            n = len({tuple(w[i : i + k]) for _, p in c for i in p})
            if n < license_scan.SHARE * len(at) and n <= license_scan.PART - k:
                continue
            held = {i - d for d, p in c for i in range(min(p), max(p) + k) if w[i] == tw[i - d]}
            if len(held) >= license_scan.SHARE * len(tw) or len(held) >= license_scan.PART and len(held) >= license_scan.ALONG * (max(held) - min(held) + 1):
                found.append((len(held) / len(tw), label))
    base = brute_base(t)
    own = {x for _, x in found if x} | {x for x in base[4].split(",") if x}
    return ",".join(sorted(own)), round(max(max(x for x, _ in found), license_scan.MENTION if base[1] else 0.0), 9)


# ---------------------------------------------------------------- SimHash


def brute_print(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(prints):
    up = {i: i for i, _ in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (a, x) in enumerate(prints):
        for b, y in prints[:n]:
            if (x ^ y).bit_count() <= 2:
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {i: root(i) for i, _ in prints}


def test_fingerprints(spark):
    rows = ODD + [(1, "A b\tC d e"), (2, "x"), (3, "x y"), (3, "x y"), (4, "É é\u00a0z q")]
    got = {(r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(frame(spark, rows, "fp string")).collect()}
    assert got == {(d, brute_print(t)) for d, t in rows}


def test_simhash_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()] + [(5000, ""), (4999, None)]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    prints = [(d, brute_print(t)) for d, t in rows]
    want = brute_components(prints)
    assert got == {d: (f, want[d]) for d, f in prints}


def test_links_and_chains(spark):
    r = random.Random(4)
    prints = [(i, r.getrandbits(64)) for i in range(100, 130)]
    x = r.getrandbits(64)
    for i in r.sample(range(60), 60):  # chains of one and two bits, and dense balls
        x = x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        prints.append((i, x))
    prints += [(200 + b, x ^ (1 << b)) for b in range(64)]
    seen = set()
    prints = [(i, f) for i, f in prints if not (f in seen or seen.add(f))]
    df = spark.createDataFrame([(simhash.signed(f), i) for i, f in prints], "fp long, node long")
    got = {t.node: t.component for t in simhash.components(simhash.links(df)).collect()}
    want = brute_components(prints)
    assert all(got.get(i, i) == want[i] for i, _ in prints)
    near = {frozenset((a, b)) for n, (a, x) in enumerate(prints) for b, y in prints[:n] if (x ^ y).bit_count() <= 2}
    assert all(any((x ^ y) & m == 0 for m in simhash.masks()) for n, (a, x) in enumerate(prints) for b, y in prints[:n] if frozenset((a, b)) in near)


def test_empty_simhash(spark):
    assert simhash.near_duplicates(documents(spark).limit(0)).collect() == []


# ---------------------------------------------------------------- joins and the pipeline


def test_join_groups_splits_hot_keys(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, -1, id % 700) AS k")
    groups = rows.groupBy("k").count()
    got = common.join_groups(rows, groups, "k", "count")
    assert got.count() == 5000 and got.where("k = -1 AND count != 1667").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    df = documents(spark)
    good = {r.doc_id for r in quality.classify(df, queries.quality_model(spark, df, SF)).where("predicted = 1").collect()}
    rows = [(d, t) for d, t in docs.items() if d in good]
    rows = [(d, t) for d, t in rows if d in {x[0] for x in brute_exact(rows) if x[3]}]
    comp = brute_components([(d, brute_print(t)) for d, t in rows])
    rows = [(d, t) for d, t in rows if comp[d] == d]
    rows = [(d, t) for d, t in rows if d in {x[0] for x in brute_hits(rows, items) if not x[4]}]
    t = bpe.tokenizer(queries.vocabulary())
    want = {(d, len(t.encode(x, add_special_tokens=False).ids)) for d, x in rows}
    assert {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()} == want
    kept = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == df.columns


def test_stages_on_odd_documents(spark):
    import corpus_pipeline

    rows = [*ODD, (901, ""), (901, ""), (1, "plain words that make a text of some length and no more than that"), (1, "plain words that make a text of some length and no more than that"), (2, "plain words that make a text of some length and no more than that")]
    docs = spark.createDataFrame([(d, t, None, None, None, 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, count long, component_id string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        got = Counter((r.doc_id, r.text) for r in kept.collect())
        assert got <= Counter(rows), name
        if name in ("exact dedup", "SimHash near-dedup"):
            assert got[1, rows[-1][1]] == 2 and not got[2, rows[-1][1]], name  # rows with the id that stays all stay
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF).count() == len(rows) and last(spark, docs.limit(0), SF).collect() == []


def test_stages_judge_rows_of_one_id_each_by_its_text(spark):
    import corpus_pipeline

    a, b, c = ("plain words that make a text of some length and no more than that", "quite another text that has nothing to do with the first one at all", "and a third one, which says something else again and stands alone here")
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 12)
    rows = [(3, a), (5, a), (5, b), (None, b), (None, c), (5, f"x {item} y"), (None, f"z {item}")]
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda stage: Counter((r.doc_id, r.text) for r in stage(spark, docs, SF).collect())
    dups = Counter([(3, a), (5, b), (None, c), *rows[5:]])
    assert kept(corpus_pipeline.exact_once) == dups
    assert kept(corpus_pipeline.near_once) == dups
    assert kept(corpus_pipeline.uncontaminated) == Counter(rows[:5])
