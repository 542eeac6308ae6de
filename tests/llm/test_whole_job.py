"""Cases in which the training-data operators once did less than the whole job."""

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tempoweir.llm import embedding_dedup, jaccard_join, license_scan, pfair_mix, pii_surrogates, quality_pu, template_decontam
from tempoweir.llm.common import cut
from tests.llm.test_operators import docs


def hidden(spark, *texts):
    got = {r.doc_id: r.text for r in pii_surrogates.replace_pii(docs(spark, list(enumerate(texts)))).collect()}
    return [got[i] for i in range(len(texts))]


def leaks(spark, texts, items):
    got = template_decontam.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r.doc_id, r.item_id) for r in got.collect())


# ---- 4

CLIPS = "Natalia sold 48 clips in April and 24 in May total"
SHORT = "Tom has 3 red pens. Tom buys 4 more pens. Ann takes 2 old pens. Ann gives 5 new pens. Tom sells 6 blue pens. How many pens are left?"


def test_items_with_names_at_sentence_starts(spark):
    renamed = SHORT.replace("Tom", "Peter").replace("Ann", "Maria")
    texts = [(1, f"see {CLIPS}"), (2, "So. " + CLIPS.replace("Natalia", "Maria")), (3, CLIPS), (4, renamed), (5, "The sum is here"), (6, "Paris is the capital of France")]
    assert leaks(spark, texts, [(1, CLIPS), (2, SHORT), (3, "What is the capital of France?")]) == [(1, 1), (2, 1), (3, 1), (4, 2)]


def test_new_values_may_merge_split_and_run_into_neighbours(spark):
    item = "Ann had 5 apples at noon and then bought 7 pears before she gave 2 figs and 2 plums to the old man by the river"
    merged, split = item.replace("5", "6").replace("7", "6"), item.replace("2 figs", "3 figs").replace("2 plums", "4 plums")
    edge = "12 boxes hold 12 lamps each and stand in the long hall by the river"
    texts = [(1, merged), (2, split), (3, "3. " + edge), (4, item.replace("5", "8")), (4, item.replace("5", "9")), (5, item.replace("5", "7"))]
    assert leaks(spark, texts, [(1, item), (2, edge)]) == [(1, 1), (2, 1), (3, 2), (4, 1)]


def test_rows_of_one_id_do_not_mix(spark):
    row = "12 Bo 7 Al 9 Cy 5 Di 3 Ed 8 Flo 6 Gus 4 Hal 2 Ira"
    other = row.replace("12", "31").replace("7", "44").replace("9", "52")
    assert leaks(spark, [(4, "see " + row), (4, "see " + other)], [(1, "see " + row)]) == [(4, 1)]


def test_documents_without_id_are_judged(spark, tmp_path):
    items = spark.createDataFrame([(1, CLIPS), (None, SHORT)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    d = docs(spark, [(None, f"see {CLIPS}"), (None, "nothing of it here"), (7, SHORT), (8, None)])
    got = template_decontam.contamination(d, items).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == [("7", "None"), ("None", "1")]
    left = template_decontam.drop_contaminated(spark, d.withColumn("row", F.lit(1)), str(tmp_path)).collect()
    assert sorted(str(r.text) for r in left) == ["None", "nothing of it here"]


# ---- 3 and 8


def test_columns_that_clash_with_new_ones(spark, tmp_path):
    d = docs(spark, [(1, "one"), (2, None)], score_="s", _score="t")
    got = quality_pu.score_quality(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert got.columns == [*d.columns, "score__"] and {r["score_"] for r in got.collect()} == {"s"}
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert set(quality_pu.keep_good(spark, d, str(tmp_path)).columns) == set(d.columns)
    names = ["slot", "position", "stream_", "rank_", "prefix_", "here_", "plan_", "MD5_"]
    out = pfair_mix.interleave(spark, docs(spark, [(i, "x") for i in range(9)], **dict.fromkeys(names, 5)), "")
    assert out.columns[-2:] == ["slot_", "position_"] and sorted(r["position_"] for r in out.collect()) == list(range(9))
    assert {tuple(r[n] for n in names) for r in out.collect()} == {(5,) * len(names)}
    kept = jaccard_join.keep_one(spark, docs(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c")], turn_=3), "")
    assert [(r.doc_id, r["turn_"]) for r in kept.collect()] == [(1, 3)]


def test_prior_without_negative_labels():
    rng = np.random.default_rng(4)
    draw = lambda n, at: at + rng.standard_normal((n, 3))
    for share in (0.3, 0.6, 0.9):
        unlabelled = np.concatenate([draw(int(4_000 * share), 2), draw(4_000 - int(4_000 * share), -2)])
        assert abs(quality_pu.prior_from(draw(2_000, 2), unlabelled) - share) < 0.06


def test_ranks_over_many_prefixes(spark, monkeypatch):
    rows = [(i, "x") for i in range(700)]
    want = {r.doc_id: (r.slot, r.position) for r in pfair_mix.interleave(spark, docs(spark, rows), "").collect()}
    monkeypatch.setattr(pfair_mix, "PREFIX_ROWS", 0.2)  # four digits, two of them heads
    assert {r.doc_id: (r.slot, r.position) for r in pfair_mix.interleave(spark, docs(spark, rows), "").collect()} == want
    assert sorted(p for _, p in want.values()) == list(range(700))


def test_weights_with_a_common_factor(spark):
    d = docs(spark, [(i, "x") for i in range(40)]).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    one, many = ({r.doc_id: (r.slot_, r.position_) for r in pfair_mix.mix(d, {"a": 3 * f}, f, 2).collect()} for f in (1, 5_000))
    assert one == many


# ---- 9


def test_links_of_repeated_ids(spark):
    """Each row of an id links for itself; links are counted by documents and texts."""
    t, u = "a b c d e f g h i j k l m n o p q r s t", "one two three four five six seven eight nine ten eleven twelve"
    near = u + " thirteen"
    d = docs(spark, [(1, t), (2, t), (2, u), (3, u), (4, near), (9, "z")])
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in jaccard_join.jaccard_links(d, shingle=2).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 2, 2), (3, 2, 2), (4, 2, 2), (9, 0, 9)]


# ---- 10


def test_planted_pairs_among_many_vectors(spark, tmp_path):
    """50 000 vectors: 3 000 pairs at cosine 0.901 and groups of 40, against all pairs by blocks."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((43_000, 24)))
    away = rng.standard_normal((3_000, 24))
    away = unit(away - (away * base[:3_000]).sum(1, keepdims=True) * base[:3_000])
    near = 0.901 * base[:3_000] + np.sqrt(1 - 0.901**2) * away
    groups = unit(np.repeat(base[3_000:3_100], 40, 0) + 0.03 * rng.standard_normal((4_000, 24)))
    x = np.concatenate([base, near, groups])
    ids = rng.permutation(len(x)) + 5
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(x), pa.list_(pa.float64()))}), tmp_path / "v.parquet")
    rows = embedding_dedup.near_vectors(spark.read.parquet(str(tmp_path / "v.parquet"))).toPandas().set_index("vec_id").loc[ids]
    pairs = []
    for lo in range(0, len(x), 2_000):
        i, j = np.nonzero(x[lo : lo + 2_000] @ x.T >= 0.9)
        pairs.append(np.column_stack([i + lo, j])[i + lo < j])
    pairs = np.concatenate(pairs)
    links = np.bincount(pairs.ravel(), minlength=len(x))
    assert (rows.n_links.to_numpy() <= links).all() and rows.n_links.sum() >= 0.95 * links.sum()
    planted = pairs[(pairs[:, 0] < 3_000) & (pairs[:, 1] == pairs[:, 0] + 43_000)]
    assert len(planted) == 3_000 and (rows.n_links.to_numpy()[planted] > 0).all(1).mean() >= 0.95
    root = np.arange(len(x))
    while True:
        low = root.copy()
        np.minimum.at(low, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], root[pairs[:, 0]])
        low = low[low]
        if (low == root).all():
            break
        root = low
    least = np.full(len(x), ids.max() + 1)
    np.minimum.at(least, root, ids)
    right = rows.component_id.to_numpy() == least[root]
    assert right.mean() >= 0.99 and (rows.component_id.to_numpy() >= least[root]).all()
    full = rows.n_links.to_numpy() == links
    assert ((rows.component_id.to_numpy() == ids) == (least[root] == ids))[full & right].all()


# ---- 5


@pytest.mark.parametrize("left_out", [None, "ida"])
def test_surrogates_of_all_listed_names_name_nobody(spark, left_out):
    names = [n.capitalize() for n in pii_surrogates.FEMALE.split() if n != left_out]
    new = [t.split()[1] for t in hidden(spark, *[f"Mrs. {n}" for n in names])]
    assert len(set(new)) == len(names) and not set(new) & set(names)


def test_surrogates_of_a_full_space(spark):
    texts = [f"Mr. {a}{b}" for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "aeiou"]
    new = hidden(spark, *texts)
    assert len(set(new)) == len(texts) and not set(new) & set(texts)
    assert hidden(spark, "token: ____________") == ["token: ____________"]


def test_secrets_in_texts_without_digits(spark):
    hexes = "abcdefab" * 4
    a, b, c = hidden(spark, "password: correcthorsebattery", "at 7, password: correcthorsebattery", f"see {hexes} there")
    assert "correcthorse" not in a and a.split()[-1] == b.split()[-1] and hexes not in c


def test_long_secrets_leave_no_tail(spark):
    jwt, key, hexes, name = "eyJhbGci.eyJzdWIiOiIx.c2lnbmF0dXJl", "q7Rz" * 6_000, "0a1b" * 50, "Wolf" + "eschlegelstein" * 3
    a, b, c, d, e = hidden(spark, f"token={jwt}. Done", f"api_key: {key} end", f"see {hexes} end", f"Mr. {name} came", "192.168.100.200")
    parts = a.removeprefix("token=").removesuffix(". Done").split(".")
    assert [len(x) for x in parts] == [len(x) for x in jwt.split(".")] and not set(parts) & set(jwt.split("."))
    assert len(b) == len(key) + 13 and key[-20:] not in b and hexes[-20:] not in c and c.endswith(" end")
    assert name[-14:] not in d and d.startswith("Mr. ") and re.fullmatch(r"\d+(\.\d+){3}", e)


def test_formats_of_phones_cards_and_addresses(spark):
    values = [
        "(743) 555-3824", "743-555-3824", "743 555 3824", "030 1234567", "0171/1234567", "(030) 1234567", "+33 6 12 34 56 78", "+45 12 34 56 78", "06 12 34 56 78", "020 7946 0958",
        "0049 171 1234567", "3782 822463 10005", "3782-822463-10005", "2001:db8::ff00:42:8329", "fe80::1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "ab:cd:ef:ab:cd:ef:ab:cd",
    ]
    new = hidden(spark, *[f"see {v}, ok" for v in values], "tel. 12 34 56 78", "+12125551234 is +1 (212) 555-1234")
    for v, n in zip(values, new, strict=False):
        assert v not in n and re.sub(r"[0-9a-f]", "x", n[4:-4]) == re.sub(r"[0-9a-f]", "x", v), n
    assert "12 34 56 78" not in new[-2] and len({re.sub(r"\D", "", p) for p in new[-1].split(" is ")}) == 1
    assert new[3][4] == new[5][5] == "0" and re.sub(r"\D", "", new[3]) == re.sub(r"\D", "", new[5])
    beside = hidden(spark, "+1 (337) 555-7349 4111 1111 1111 1111", "+1 (337) 555-7349 2 left", "030 1234567 2024", "+44 20 7946 0958 4111 1111 1111 1111")
    for n, old in zip(beside, ("555-7349", "555-7349", "1234567", "7946 0958"), strict=True):
        assert old not in n and "1111 1111" not in n
    assert beside[1].endswith(" 2 left") and beside[0][:17] == beside[1][:17]
    plain = ["from 2019-2021 in 12.5 and 1,234,567", "01-02-2024 at 10:20:30", "10 20 30 40 50", "std::vector a::b", "0.12345678"]
    assert hidden(spark, *plain) == plain


def test_names_stay_one_person_in_a_document(spark):
    texts = ["Mr. John Smith called. John Smith then left. Smith was late, JOHN SMITH too. Johnson not.", "Mrs Xenia and Mr Xenia", "My name is Karen Miller. Miller!", "Mr. 山田太郎 came, 山田太郎は来た", "Johnson and Smith"]
    a, b, c, d, e = hidden(spark, *texts)
    first, last = re.match(r"Mr\. (\w+) (\w+) called", a).groups()
    assert a == f"Mr. {first} {last} called. {first} {last} then left. {last} was late, {first.upper()} {last.upper()} too. Johnson not." and first.lower() in pii_surrogates.MALE.split()
    she, he = re.match(r"Mrs (\w+) and Mr (\w+)", b).groups()
    assert she != he and she.endswith("a") and he[-1] not in "aeiu" and "Xenia" not in b
    assert "Karen" not in c and "Miller" not in c and re.fullmatch(r"My name is (\w+) (\w+)\. \2!", c)
    assert "山田" not in d and re.fullmatch(r"Mr\. ([\u4e00-\u9fa5]{4}) came, \1は来た", d)
    assert e == texts[4]


def test_ibans_keep_country_length_and_check(spark):
    values = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO9386011117947"]
    for old, new in zip(values, hidden(spark, *[f"to {v}." for v in values]), strict=True):
        new = new[3:-1]
        plain = new.replace(" ", "")
        assert new[:2] == old[:2] and new[5:] != old[5:] and re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", new)) == re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", old))
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def permuted(values, radices, tweak):
    """The keyed permutation, written down a second time."""
    tweak = f"{tweak}|{','.join(map(str, radices))}"
    for r in range(pii_surrogates.ROUNDS):
        rest = ",".join(str(v) for i, v in enumerate(values) if i % 2 != r % 2)
        seed = hashlib.sha256(f"{tweak}|{r}|{rest}".encode()).hexdigest()
        values = [(v + int(seed[i * 4 % 56 : i * 4 % 56 + 6], 16)) % radices[i] if i % 2 == r % 2 else v for i, v in enumerate(values)]
    return values


def test_surrogates_against_a_second_permutation(spark):
    """Social security numbers, letter by letter of names and secrets, and collisions, by plain Python over all texts."""
    ssns = [f"{i:03d}-45-{1000 + 7 * i}" for i in range(300)]
    names = [a + b + c for a in "BCDF" for b in "aeiou" for c in ("rtel", "na", "k")]
    secrets = [f"{i}abcdefxyz{i}Q" for i in range(100, 150)]
    texts = [f"{s}, Dr. {n}, token={k}; copy" for s, n, k in zip(ssns, names * 5, secrets * 6, strict=True)] + ["nothing", None]
    made = {}
    for kind, values in (("ssn", ssns), ("name", names), ("secret", secrets)):
        tries = dict.fromkeys(values, 0)
        while True:
            new = {}
            for v, n in tries.items():
                tweak = "|".join([pii_surrogates.DEFAULT_KEY, kind, str(n)] + ["N"] * (kind == "name") + ["ssn" if kind == "ssn" else "name" if kind == "name" else "secret"])
                sets = {"ssn": ["0123456789"], "name": ["aeiou", "bcdfghjklmnpqrstvwxyz"], "secret": ["0123456789", "abcdefghijklmnopqrstuvwxyz"]}[kind]
                own = [next((s for s in sets if c.lower() in s), None) for c in v]
                moved = iter(permuted([s.index(c.lower()) for c, s in zip(v, own, strict=True) if s], [len(s) for s in own if s], tweak))
                letters = [s[next(moved)] if s else c for c, s in zip(v, own, strict=True)]
                new[v] = "".join(x.upper() if c.isupper() else x for c, x in zip(v, letters, strict=True))
            taken, least = {v.lower() for v in values}, {}
            for v in sorted(values):
                least.setdefault(new[v].lower(), v)
            again = [v for v in values if new[v].lower() in taken or least[new[v].lower()] != v]
            if not again:
                break
            for v in again:
                tries[v] += 1
        made |= new
    want = [f"{made[s]}, Dr. {made[n]}, token={made[k]}; copy" for s, n, k in zip(ssns, names * 5, secrets * 6, strict=True)] + ["nothing", None]
    assert hidden(spark, *texts) == want


def test_columns_with_names_of_helpers(spark):
    d = docs(spark, [(1, "to ab.1@mail3.example.com")], a_="x", of_=1, found_="f", n_entities_=9, pattern_="p", between_="q", B_=2)
    got = pii_surrogates.replace_pii(d)
    row = got.first()
    assert (row["a_"], row["of_"], row["found_"], row["n_entities_"], row["pattern_"], row["between_"], row["B_"]) == ("x", 1, "f", 1, "p", "q", 2) and "ab.1@" not in row["text"]


# ---- 7

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{}
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NAMES = "{}. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ADVERTS = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Some Body.\n"


def test_license_texts_count_by_their_full_wording(spark):
    texts = [
        (1, MIT.format("")), (2, MIT.format("The Software shall be used for Good, not Evil.")), (3, MIT[:300]), (4, BSD.format("")), (5, BSD.format(NAMES.format(3))),
        (6, BSD.format(ADVERTS + NAMES.format(4))), (7, BSD[:170]), (8, MIT.format("").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")),
    ]
    got = {r.doc_id: sorted({m.label for m in r.matches}) for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert got == {1: ["mit-text"], 2: [], 3: [], 4: ["bsd-2-text"], 5: ["bsd-3-text"], 6: ["bsd-4-text"], 7: [], 8: ["mit-text"]}


# ---- pipeline


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null texts and ids, repeated rows, long texts, clashing columns; then tables without rows."""
    import corpus_pipeline
    from tests.llm.test_operators import LONG, ODD, words

    good = [(100 + i, f"mail me at ab.{i}@mail3.example.com. " + words(60, 50 + i)) for i in range(6)]
    copies = [(200, LONG), (201, LONG), (100, good[0][1])]
    d = docs(spark, [*ODD, *good, *copies], slot=1, turn_=2, found_="x", row=3)
    d.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i, _ in good] + [(3, None), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "a" / "labels.parquet"))
    spark.createDataFrame([(1, good[1][1]), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "a"))
    rows = out.collect()
    assert set(d.columns) < set(out.columns) and sorted(r.position for r in rows) == list(range(len(rows)))
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 101 not in ids and len({6, 7, 200, 201} & set(ids)) <= 1 and 100 in ids
    assert {(r.slot, r.turn_, r.found_, r.row) for r in rows} <= {(1, 2, "x", 3)} and not any("ab." in (r.text or "") for r in rows)
    for name, kind in (("documents", d.schema), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / "b" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def _shuffles(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in files.split("\n") if "/shuffle_" in x}


def _left(spark, before: set[str]) -> set[str]:
    # deleted by another thread
    end = time.time() + 20
    while (left := _shuffles(spark) - before) and time.time() < end:
        time.sleep(0.2)
    return left


def test_cut_frames_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = _shuffles(spark), spark.conf.get(key)
    # held until the end, so that the driver's garbage collection deletes nothing
    frame = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count()
    whole = cut(frame)
    assert not _left(spark, before)
    assert spark.conf.get(key) == held
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, frame.collect())) and whole.columns == frame.columns


def test_near_copies_leave_only_the_shuffles_of_the_result(spark, monkeypatch):
    made = []
    monkeypatch.setattr(jaccard_join, "cut", lambda df: made.append(df) or cut(df))
    text = "one two three four five six seven eight nine ten eleven twelve"
    before = _shuffles(spark)
    kept = jaccard_join.keep_one(spark, docs(spark, [(1, text), (2, text + " x"), (3, "other words of another text"), (4, None)]), "")
    assert made and not _left(spark, before)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
