"""The training-data operators against brute force, on odd rows and on the driver's small tables."""

import base64
import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempoweir.llm import (
    embedding_dedup, graph, jaccard_join, license_scan, pfair_mix, pii_surrogates, quality_pu, registry, substring_dedup, template_decontam, tokens, url_filter, warc_zip,
)

DATA = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
small = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeé"), 5)) for _ in range(n))


def docs(spark, texts, **more):
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOC)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


LONG = words(30_000, 5)
ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, words(40)), (5, words(40)), (6, LONG), (7, LONG + " tail"), (None, words(40)), (8, "Ünï çødé \x00 \x01 😀 " * 8), (8, "Ünï çødé \x00 \x01 😀 " * 8)]


# ---- shared parts


def test_tokens_match_split():
    import pyarrow as pa

    texts = [t for _, t in ODD]
    got = [w.data[a:z].tobytes() for w in tokens.words(pa.array(texts), chunk=500) for a, z in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in texts for x in (t or "").encode().split()]
    hashes = np.concatenate([w.hashes for w in tokens.words(pa.array(texts), chunk=500)])
    assert len(set(zip(got, hashes.tolist(), strict=True))) == len(set(got)) == len(set(hashes.tolist()))


def test_rolling_equals_equal_windows():
    h = np.array([1, 2, 3, 1, 2, 3, 9], np.uint64)
    for k in (1, 2, 3, 5, 7):
        r = tokens.rolling(h, k)
        assert len(r) == len(h) - k + 1
        for i in range(len(r)):
            for j in range(len(r)):
                assert (r[i] == r[j]) == (h[i : i + k].tolist() == h[j : j + k].tolist())


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1


def test_url_filter(spark):
    urls = [
        (1, "http://a.org/x", "allow", "org/"), (2, "https://EXAMPLE.org/es/1?q", "block", "example.org/es/"), (3, "http://www.example.org/en/123#t", "block", "example.org/en/1"),
        (4, "http://example.org", "allow", None), (5, "http://x.com/fr/1", "allow", "com/fr/"), (6, "http://x.com/de/1", "block", "com/de/"), (7, None, "allow", None), (8, "nothing", "allow", None),
        (9, "http://badexample.org/es/", "allow", "org/"), (10, "http://m.ththth.example.net/en/25/", "block", None), (11, "", "allow", None), (12, "http://x.net/a://b.org/c", "allow", None),
        (13, "http://x.com/de/" + "a" * 50_000, "block", "com/de/"), (13, "http://x.com/de/" + "a" * 50_000, "block", "com/de/"),
    ]
    pages = spark.createDataFrame([(i, u, "v", "r", "k") for i, u, *_ in urls], "page_id long, url string, verdict string, rule string, key string")
    many = [f"h{i}.example.net/en/{i}" for i in range(5_000)]
    listed = spark.createDataFrame([(u,) for u in ["m.ththth.example.net/en/25", "m.ththth.example.net/en/25", None, *many]], "key string")
    got = sorted((r.page_id, r.verdict, r.rule or "") for r in url_filter.filter_urls(pages, listed).collect())
    assert got == sorted((i, v, r or "") for i, _, v, r in urls)
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, listed.limit(0), ()).collect()} == {"allow"}


# ---- 2


def brute_windows(rows, k):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = set(), []
    for i, t in order:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen:
                gone[s : s + k] = [True] * k
            seen.add(key)
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def test_substring_dedup(spark):
    passage = words(60, 9)
    rows = [*ODD, (20, words(10, 1) + " " + passage + " " + words(9, 2)), (21, words(7, 3) + "\n" + passage), (22, "a b " * 300)]
    got = substring_dedup.dedup_substrings(docs(spark, rows, kept_text="x", spans=1))
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()])) == sorted(map(str, brute_windows(rows, 20)))
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert substring_dedup.dedup_substrings(docs(spark, [])).count() == 0


# ---- 3


@small
def test_quality(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    out = quality_pu.op3_quality_pu(spark, DATA).toPandas()
    assert len(out) == d.count() and out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(out.doc_id, out.held_out, strict=True))
    lab = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().merge(out, on="doc_id")
    assert (lab[lab.held_out].predicted == lab[lab.held_out].quality).mean() > 0.9
    assert quality_pu.score_quality(d.limit(0), spark.read.parquet(f"{DATA}/labels.parquet")).count() == 0


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(12)] + [(4, None), (None, 1)], "doc_id long, quality int")
    got = quality_pu.score_quality(docs(spark, ODD, quality=0, trusted=True), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score_ <= 1 for r in got)
    none = quality_pu.score_quality(docs(spark, ODD), labels.where("quality = 0")).collect()
    assert {r.score_ for r in none} == {0.5}


# ---- 4

ITEM = "The train leaves at 9 and covers 120 km before it meets Anna at the old bridge near the mill, so how long does the whole trip take?"


def test_decontamination(spark):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (1, ITEM)], "item_id long, text string")
    again = ITEM.replace("120", "345").replace("Anna", "Peter").replace(" 9 ", " 11 ")
    twisted = "Anna and 5 here. The train leaves at 120 and covers 120 km before it meets Anna at the old bridge near the mill, so how long does the whole trip take?"
    rows = [*ODD, (30, "Intro. " + ITEM), (31, words(20) + ". " + again + " " + words(5)), (32, ITEM.upper()), (33, twisted), (34, ITEM[:30])]
    got = template_decontam.contamination(docs(spark, rows, at=1, slots=2, item_id=3), items)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(30, 1), (31, 1), (32, 1)]
    assert template_decontam.contamination(docs(spark, []), items).count() == 0
    assert template_decontam.contamination(docs(spark, rows), items.limit(0)).count() == 0


@small
def test_decontamination_against_words(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    texts = {r.doc_id: " ".join(plain(r.text)) for r in d}
    want = set()
    for b in items:
        w = plain(b.text)
        for g in (" ".join(w[k : k + 13]) for k in range(max(1, len(w) - 12))):
            want |= {(i, b.item_id) for i, t in texts.items() if g in t}
    assert {(r.doc_id, r.item_id) for r in template_decontam.op4_template_decontam(spark, DATA).collect()} == want


# ---- 5


def test_surrogates(spark):
    text = (
        "Mail Anna.1@mail3.example.com, then anna.1@MAIL3.example.com. Mr. John Smith met Mrs Anna Ochoa; +1 (337) 555-7349 is +1-337-555-7349. "
        'Card 4111 1111 1111 1111, host 10.0.0.255, token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", 123-45-6789.'
    )
    rows = [*ODD, (40, text), (41, "again John.x@mail3.example.com and Mr. John Smith"), (41, "again John.x@mail3.example.com and Mr. John Smith")]
    got = {r.doc_id: r for r in pii_surrogates.replace_pii(docs(spark, rows, e="x", kind="y", _n=1)).collect()}
    for i, t in ODD:
        assert got[i].text == t and got[i].n_entities_ == 0
    new = got[40].text
    for value in ("Anna.1@", "Smith", "555-7349", "1111 1111", "10.0.0.255", "2abc3ff2", "123-45-6789"):
        assert value not in new
    mails = re.findall(r"\S+@\S+\.com", new)
    assert mails[0].lower() == mails[1].lower() and mails[0].split("@")[1] != mails[1].split("@")[1]
    phones = re.findall(r"\+1[ -]\(?\d{3}\)?[ -]\d{3}-\d{4}", new)
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1
    card = re.search(r"Card ([\d ]+),", new)[1]
    digits = [int(c) for c in card.replace(" ", "")]
    assert card[4] == " " and digits[0] == 4 and sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    first = re.search(r"Mr\. (\w+) (\w+) met Mrs (\w+)", new)
    assert first[1].lower() in pii_surrogates.MALE.split() and first[3].lower() in pii_surrogates.FEMALE.split()
    assert f"Mr. {first[1]} {first[2]}" in got[41].text
    assert pii_surrogates.replace_pii(docs(spark, [])).count() == 0


def test_permutation_is_one_to_one(spark):
    ids = spark.range(2_000)
    v = F.array(F.floor(F.col("id") / 200), F.floor(F.col("id") / 10) % 20, F.col("id") % 10)
    p = pii_surrogates.permuted(v, F.array(F.lit(10).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long")), F.lit("k"))
    got = {tuple(r[0]) for r in ids.select(p).collect()}
    assert len(got) == 2_000 and all(a < 10 and b < 20 and c < 10 for a, b, c in got)


def test_taken_surrogates_are_replaced(spark):
    """An entity whose first surrogate is an original of the corpus gets another one."""
    mail = "ab.1@mail3.example.com"
    first = pii_surrogates.replace_pii(docs(spark, [(1, mail)])).first().text
    got = {r.doc_id: r.text for r in pii_surrogates.replace_pii(docs(spark, [(1, mail), (2, f"see {first}")])).collect()}
    assert got[1] not in (mail, first) and first not in got[2] and len({got[1], got[2].split()[1]}) == 2


# ---- 6


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "v", LONG), (6, "v", "x"), (6, "v", "x"), (None, "w", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, sum string")
    written = warc_zip.write_packages(pages, f"file://{tmp_path}/w")
    got = warc_zip.read_packages(written).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for r in got:
        h = [x[2] or "" for x in rows if x[0] == r.page_id][0]
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h] == r.page_id else ("revisit", first[h]))
        assert r.payload == (h.encode() if r.record_type == "response" else b"")
    assert warc_zip.read_packages(warc_zip.write_packages(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


@pytest.mark.parametrize("zip64", [True, False])
def test_zip_directories(tmp_path, zip64):
    import zipfile

    data = b"".join(warc_zip.zip_package([("a", b"hello"), ("dir/é", b"x" * 1000)], zip64))
    found = warc_zip.members(lambda at, n: data[at : at + n], len(data))
    assert {k: data[a : a + n] for k, (a, n, _) in found.items()} == {"a": b"hello", "dir/é": b"x" * 1000}
    (tmp_path / "z.zip").write_bytes(data)
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert z.testzip() is None and z.read("dir/é") == b"x" * 1000
    with pytest.raises(ValueError):
        warc_zip.members(lambda at, n: b"nothing"[at : at + n], 7)
    if not zip64:
        said = data[:-2] + (40).to_bytes(2, "little") + b"a PK\x05\x06 comment".ljust(40, b".")
        assert warc_zip.members(lambda at, n: said[at : at + n], len(said)) == found


def test_packages_of_others(spark, tmp_path):
    """Several archives, a gzipped CDX and a deflated CDXJ that both name a record, members that no index names."""
    import gzip
    import json
    import zipfile

    raw = [warc_zip._record({"page_id": i, "url": f"http://a/{i}", "html": f"<p>{i}</p>", "first": None}) for i in range(5)]
    cdx = " CDX N b a m s k r M S V g\n" + "".join(f"a)/ 2024 http://a/{i} text/html 200 X - - {len(raw[i])} {sum(map(len, raw[:i]))} a.warc.gz\n" for i in range(3))
    places = [("b.warc.gz", 0, len(raw[3])), ("archive/b.warc.gz", len(raw[3]), len(raw[4])), ("a.warc.gz", 0, len(raw[0]))]
    cdxj = "".join("a)/ 2024 " + json.dumps({"filename": f, "offset": str(o), "length": n}) + "\n" for f, o, n in places)
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("archive/a.warc.gz", b"".join(raw[:3]))
        z.writestr("archive/b.warc.gz", b"".join(raw[3:]))
        z.writestr("indexes/index.cdx.gz", gzip.compress(cdx.encode()))
        z.writestr("indexes/b.cdxj", cdxj, zipfile.ZIP_DEFLATED)
        z.writestr("pages/pages.jsonl", "{}", zipfile.ZIP_DEFLATED)
        z.comment = b"made elsewhere"
    got = warc_zip.read_packages(spark.createDataFrame([(f"file://{tmp_path}/x.zip",)], "package string")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(i, f"<p>{i}</p>".encode()) for i in range(5)]


# ---- 7


def test_license_scan(spark):
    rows = [
        *ODD, (50, "Code. Licensed under the Apache License, Version 2.0. All Rights  reserved"), (51, 'licensed under the apache license (the "License") version 2'),
        (52, "GENERAL-public_license general public license cc by cc by"), (53, "licensed under the apache license copy version 2.0"), (54, "distributed under the terms of the MIT License"),
        (55, "Copyright (c) 2019 2021 Some Body and contributors. All rights reserved."), (55, "cc by"),
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, rows, labels="x", matches=1, score="s")).collect()}
    labels = {i: sorted({m.label for m in got[i].matches}) for i in range(50, 55)}
    assert labels == {50: ["apache", "reserved"], 51: ["apache"], 52: ["cc-by", "gpl"], 53: [], 54: ["mit"]}
    assert sum(m.base for m in got[52].matches) == 4 and got[0].n_words == 0 and got[1].score == 0.0
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


@small
def test_license_places_against_words(spark):
    """All base columns of the query, by phrases looked up word by word; other columns of the rows follow from them."""
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    lower = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
    odd = "cc by cc by, all rights reserved. All rights reserved general public license"
    for rows, got in (
        (spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect(), license_scan.op7_license_scan(spark, DATA).collect()),
        ([(i, t) for i, t in [*ODD[:8], (99, odd)]], license_scan.digest(license_scan.scan_licenses(docs(spark, [*ODD[:8], (99, odd)]))).collect()),
    ):
        got = {r.doc_id: r for r in got}
        assert len(got) == len(rows)
        for i, t in rows:
            w = [x.decode() for x in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(lower))]
            places = [(k, name) for name, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
            r = got[i]
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=[None])[0], max(places, default=[None])[0])
            assert r.base_labels == ",".join(sorted({n for _, n in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
            assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_license_templates(spark):
    with pytest.raises(ValueError):
        license_scan.compile_template("x", "<<beginOptional>>all<<endOptional>>")


# ---- 8


@small
def test_mixing(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, slot, position FROM ({registry.oracle_sql()['op8_pfair_mix']})").fetchall())
    assert sorted((r.doc_id, r.slot, r.position) for r in pfair_mix.op8_pfair_mix(spark, DATA).collect()) == want


def test_mixing_deviation(spark):
    weights, others, block = {"a": 5, "b": 3}, 2, 4
    rows = [(i, "ab"[i % 2] if i % 5 else None, "en") for i in range(1_000)] + [(None, "a", "en"), (3, "b", "en"), (3, "b", "en")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    got = pfair_mix.mix(df, weights, others, block).collect()
    assert sorted(r.position_ for r in got) == list(range(len(rows)))
    by = collections.defaultdict(set)
    for r in got:
        by[r.stream_].add(r.slot_)
    last = min(max(s) for s in by.values())
    for s, w in enumerate((5, 3, 2)):
        for t in range(1, last + 1):
            assert abs(sum(x < t for x in by[s]) - w * t / 10) < 1
    assert pfair_mix.mix(df.limit(0), weights, others).count() == 0


# ---- 9


def brute_jaccard(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(root(i)) if i is not None else "None") for i, s in sets)


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 4, 5), (3, 1, 2)])
def test_jaccard(spark, k, num, den):
    rng = np.random.default_rng(k)
    rows = list(ODD)
    for base in range(12):
        w = words(int(rng.integers(4, 160)), 100 + base).split()
        for copy in range(6):
            v = list(w)
            for _ in range(copy * max(1, len(w) // 60)):
                v[int(rng.integers(len(v)))] = f"x{rng.integers(1_000)}"
            rows.append((100 + base * 10 + copy, " ".join(v)))
    got = jaccard_join.jaccard_links(docs(spark, rows, n=1, node="x", cluster=2), shingle=k, similarity=(num, den)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_jaccard(rows, k, num, den)
    assert jaccard_join.jaccard_links(docs(spark, [])).count() == 0


def test_sketches_join_all_that_link():
    """All links lie within what pairs by sketches join; sets that share nothing stay apart."""
    rng = np.random.default_rng(2)
    draw = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    for num, den in ((4, 5), (85, 100), (3, 10)):
        for case in range(20):
            sets = []
            for _ in range(10):
                base = draw(int(rng.integers(1, 300)))
                sets += [np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() * 0.3], draw(int(rng.integers(1, 20)))])) for _ in range(int(rng.integers(1, 6)))]
            n, side = np.array([len(s) for s in sets]), rng.integers(1, 3, len(sets)) if case % 2 else np.zeros(len(sets), int)
            common = jaccard_join.intersections(sets)
            linked = (common > 0) & (den * common >= num * (n[:, None] + n[None, :] - common)) & ~np.eye(len(n), dtype=bool)
            linked &= (side[:, None] != side[None, :]) | (case % 2 == 0)
            label = np.arange(len(n))
            for i, j in jaccard_join._near([jaccard_join.sketch(s) for s in sets], n, side, num, den):
                label[label == label[i]] = label[j]
            assert all(label[i] == label[j] for i, j in np.argwhere(linked))
    apart = [np.unique(draw(int(k))) for k in rng.integers(100, 140, 300)]
    assert not jaccard_join._near([jaccard_join.sketch(s) for s in apart], np.array([len(s) for s in apart]), np.zeros(300, int), 4, 5)


def test_chained_texts_are_not_dealt_together(spark, monkeypatch):
    """Texts that meet by chance, chained to one cluster, are sent once and not to a task for each CHUNK of them; near copies among them link."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    monkeypatch.setattr(jaccard_join, "SKETCHES", 32)
    rng, dealt, deal = np.random.default_rng(5), [], jaccard_join._tasks

    def counted(members, num, den, chunk=8):
        made = deal(members, num, den, chunk)
        if chunk == 8:
            dealt.append((members.count(), made.count()))
        return made

    monkeypatch.setattr(jaccard_join, "_tasks", counted)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, n))
    rows, last = [], [word(30) for _ in range(3)]
    for i in range(200):  # each text has half of the one before it
        last = [last[1], last[2], word(30)]
        rows.append((i, " ".join(last)))
    rows += [(1_000 + i, t + " " + word(2)) for i, t in rows[:150:10]]
    whole, once = graph.components, []

    def chained(links, *a):
        if once:
            return whole(links, *a)
        once.append(True)  # as if all had met
        nodes = whole(links, *a).select("node")
        every = spark.createDataFrame([(i,) for i, _ in rows], "node bigint")
        return every.unionByName(nodes).distinct().withColumn("component", F.lit(0).cast("long"))

    monkeypatch.setattr(jaccard_join, "components", chained)
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (1, i) if i < 150 and i % 10 == 0 else (1, i - 1_000) if i >= 1_000 else (0, i) for i, _ in rows}
    assert len(dealt) == 1 and dealt[0][1] <= 2 * 15 + 20


def test_jaccard_large_cluster(spark, monkeypatch):
    """Clusters above a chunk are dealt in pairs of chunks and lose no link."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    w = words(60, 77).split()
    rows = [(i, " ".join([*w[: 60 - i % 7], *(f"y{i}{j}" for j in range(i % 5))])) for i in range(60)]
    got = jaccard_join.jaccard_links(docs(spark, rows), shingle=4, similarity=(85, 100)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_jaccard(rows, 4, 85, 100)


# ---- 10


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 16))
    x = np.concatenate([base + 0.05 * rng.standard_normal(base.shape) for _ in range(6)] + [base[:3], 2 * base[:2]])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0, None]), (505, [1.0, 0.0]), (506, [2.0, 0.0]), (506, [2.0, 0.0]), (None, None)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).where("vec_id is not null").collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    up = list(range(len(x)))
    for i in range(len(x)):
        for j in np.flatnonzero(near[i]):
            a, b = i, int(j)
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    want = [(i, int(near[i].sum()) - 1, root(i)) for i in range(len(x))]
    found = sum(n for _, n, _ in got if _ is not None and n)
    assert sum(n for i, n, _ in got if i < 500) >= 0.95 * sum(n for _, n, _ in want) and found
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=False))
    assert [g for g in got if g[0] >= 500] == [(500, 0, 500), (501, 0, 501), (502, 0, 502), (503, 0, 503), (504, 0, 504), (505, 2, 505), (506, 2, 505), (506, 2, 505)]
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


# ---- registry and pipeline


def test_names():
    assert sorted({int(m[1]) for n in registry.queries() if (m := re.match(r"op(\d+)_", n))}) == list(range(1, 11))
    assert "pipeline" in registry.queries()


@small
def test_pipeline_stages(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "pii", "mixing"]
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(d.columns) < set(out.columns) and out.doc_id.is_unique and sorted(out.position) == list(range(len(out)))
    good = {r.doc_id for r in quality_pu.op3_quality_pu(spark, DATA).where("predicted = 1").collect()}
    dirty = {r.doc_id for r in template_decontam.op4_template_decontam(spark, DATA).collect()}
    kept = {r.doc_id: r.text for r in d.collect() if r.doc_id in good}
    least = {int(c) for _, _, c in brute_jaccard([(i, t) for i, t in kept.items()], 5, 4, 5)}
    assert set(out.doc_id) == least - dirty
