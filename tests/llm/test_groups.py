"""Operators that bring documents together, against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import fixture
from tillwatch.llm import lines, mixing, neardup, toxicity
from tillwatch.llm.common import components


@pytest.fixture(scope="module")
def docs(spark):
    return fixture.documents(spark).cache()


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def shingles(text, size):
    words = fixture.plain_words(fixture.ascii_lower(text))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)] if words else [])


def plain_groups(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("rounds", [0, 1])
def test_near_duplicates(docs, monkeypatch, rounds):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    rows = rows_of(docs)
    sets, root = plain_groups(rows, 3, 85)
    members = {}
    for (doc_id, _), r in zip(rows, root):
        members.setdefault(r, []).append(doc_id)
    want = []
    for (doc_id, _), s, r in zip(rows, sets, root):
        ids = [i for i in members[r] if i is not None]
        first = min(ids) if ids else None
        want.append((doc_id, len(s), first, doc_id == first))
    assert fixture.plain(neardup.group_digest(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


def test_one_document_of_each_group_stays(docs):
    rows = rows_of(docs)
    sets, root = plain_groups(rows, 5, 80)
    out = neardup.drop_duplicates(docs)
    assert out.columns == docs.columns
    # Documents without words are linked with nothing; a repeated row of them would be dropped, here there is none.
    assert out.count() == len({r for r, s in zip(root, sets) if s}) + sum(not s for s in sets)
    assert neardup.group_digest(docs.limit(0)).count() == 0


def test_documents_without_words_all_stay(spark):
    rows = [(None, None), (None, None), (None, ""), (None, ""), (2, " \n"), (2, " \n"), (1, "a b c"), (1, "a b c"), (None, "a b c")]
    out = neardup.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert fixture.plain(out, "doc_id", "text") == sorted([*rows[:6], (1, "a b c")], key=repr)


def test_samples_estimate_similarity():
    known = neardup.WordHashes()
    sampler = neardup.Sampler(85)
    a = neardup.shingle_set(" ".join(f"w{i}" for i in range(2000)).encode(), 3, known)
    b = neardup.shingle_set(" ".join(f"w{i}" for i in range(100, 2000)).encode(), 3, known)
    same = (sampler.samples(a) == sampler.samples(b)).mean()
    assert abs(same - 0.95) < 0.08
    apart = np.unpackbits((sampler.sketch(sampler.samples(a)) ^ sampler.sketch(sampler.samples(b))).view(np.uint8)).sum()
    assert apart <= neardup.most_different(85)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102)] + [(200, 200 + i) for i in range(1, 9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{200 + i: 200 for i in range(9)}}


def plain_removed(rows):
    """(doc_id, text) -> numbers of the lines with an earlier similar line."""
    ordered = sorted({r: None for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = [], {}
    for doc_id, text in ordered:
        out[doc_id, text] = []
        for number, line in enumerate((text or "").split("\n")):
            tokens = set(fixture.plain_words(fixture.ascii_lower(line)))
            if len(tokens) < lines.MIN_TOKENS:
                continue
            if any(100 * len(tokens & s) >= lines.PERCENT * len(tokens | s) for s in seen):
                out[doc_id, text].append(number)
            seen.append(tokens)
    return out


@pytest.mark.parametrize("hot, pairs", [(200_000, 20_000), (200_000, 1), (2, 3)])
def test_line_dedup(docs, monkeypatch, hot, pairs):
    monkeypatch.setattr(lines, "PAIR_WORDS", pairs)  # rare tokens, frequent ones, or both kinds of key
    monkeypatch.setattr(lines, "HOT_LINES", hot)
    monkeypatch.setattr(lines, "HOT_FACTOR", 0 if hot == 2 else 8)
    rows = [r for r in rows_of(docs) if r[0] is not None]  # of two rows without an id, the order is by hash
    want = plain_removed(rows)
    got = lines.line_digest(docs.where("doc_id is not null"))
    expected = [(d, 0 if t is None else t.count("\n") + 1, len(want[d, t]), ",".join(map(str, want[d, t]))) for d, t in rows]
    assert fixture.plain(got, "doc_id", "n_lines", "n_removed", "removed_lines") == sorted(expected, key=repr)


def test_lines_alone_in_their_salts_meet(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_LINES", 2)
    monkeypatch.setattr(lines, "HOT_FACTOR", 0)
    pairs = 12  # of words of their own, so that each list holds one pair, in equal or in different salts
    texts = [" ".join(f"p{n}w{i}" for i in range(start, start + 10)) for n in range(pairs) for start in (0, 1)]
    got = lines.line_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {i: i % 2 for i in range(2 * pairs)}


@pytest.mark.parametrize("pairs", [1, 10**9])
def test_lines_at_the_threshold_meet(spark, monkeypatch, pairs):
    """Sets of every size and overlap around the threshold, from few words, so that all of them are frequent."""
    import random

    monkeypatch.setattr(lines, "PAIR_WORDS", pairs)
    monkeypatch.setattr(lines, "LONG", 9)  # wide bitmaps for some, none for others
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for size in range(1, 24):
        for _ in range(4):
            kept = rng.sample(words, size)
            texts.append(" ".join(kept))
            out = rng.sample(kept, size - rng.randint(0, min(size - 1, 4)))
            texts.append(" ".join(out + rng.sample([w for w in words if w not in kept], rng.randint(0, 3))))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["removed_lines"] for r in lines.line_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = {d: ",".join(map(str, gone)) for (d, _), gone in plain_removed(rows).items()}
    assert got == want and 20 < sum(map(bool, want.values())) < 160


def test_short_lines_are_compared(spark):
    page = "Home\nabout us\n\nall rights reserved\none two three four"
    texts = [page, "HOME", "us about", "rights reserved", "four three two one five", "all rights reserved now", page, "na na na na na\n \nna"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r["doc_id"]: r["removed_lines"] for r in lines.line_digest(docs).collect()}
    assert removed == {0: "", 1: "0", 2: "0", 3: "", 4: "0", 5: "", 6: "0,1,3,4", 7: "2"}
    assert removed == {d: ",".join(map(str, gone)) for (d, _), gone in plain_removed(rows).items()}
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert kept == {0: page, 3: texts[3], 5: texts[5], 7: "na na na na na\n "}


def test_line_dedup_texts(docs):
    rows = [r for r in rows_of(docs) if r[0] is not None]
    want = plain_removed(rows)
    out = lines.dedup_lines(docs.where("doc_id is not null"))
    assert out.columns == docs.columns
    expected = []
    for doc_id, text in rows:
        gone = want[doc_id, text]
        kept = text if not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        if not gone or fixture.plain_words(kept):
            expected.append((doc_id, kept, None if text is None else len(kept)))
    assert fixture.plain(out, "doc_id", "text", "n_chars") == sorted(expected, key=repr)
    assert lines.line_digest(docs.limit(0)).count() == 0


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        assert 0 <= r["mix_taken"] <= 3 * r["mix_size"]
        assert r["mix_size"] == len(fixture.plain_words(r["text"]))
        by.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["mix_size"] for r in rows) for s, rows in by.items()}
    assert sum(rows[0]["mix_target"] for rows in by.values()) == pytest.approx(sum(sizes.values()))
    for source, rows in by.items():
        target = rows[0]["mix_target"]
        assert target <= 3 * sizes[source]
        assert abs(sum(r["mix_taken"] for r in rows) - target) <= 2
    again = Counter((r["doc_id"], r["mix_taken"]) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == Counter((r["doc_id"], r["mix_taken"]) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_share_what_caps_cut_off():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == {"a": 50.0, "b": 100.0, "c": 150.0}
    assert mixing.targets([(None, 10), ("a", 1000), ("b", 5)]) == {"a": 970.0, "b": 15.0, None: 30.0}
    assert mixing.targets([("a", 0)]) == {"a": 0.0}


def test_budgets_equal_the_plain_targets(spark):
    for sizes in ([("a", 100), ("b", 100), ("c", 100)], [(None, 10), ("a", 1000), ("b", 5)], [("a", 0)], [(f"s{i:02d}", i * i % 37 * 50) for i in range(40)]):
        got = mixing.budgets(spark.createDataFrame(sizes, "source string, size long"), 3).collect()
        assert {r["source"]: r["target"] for r in got} == mixing.targets(sizes)
        assert all(r["epochs"] * r["source_size"] + r["rest"] in (int(r["target"]), 0) for r in got)


def test_mixing_collects_nothing(docs, monkeypatch):
    monkeypatch.setattr(type(docs), "collect", lambda self: pytest.fail("rows were collected"))
    mixing.mix(docs)


def toxic_tables(spark):
    import random

    rng = random.Random(5)
    rows, marks = [], []
    for i in range(400):
        words = fixture.babble(rng, 60)
        toxic = i % 5 == 0
        if toxic:
            for w in ("vilewort", "grimslur", "foulterm"):
                words.insert(rng.randrange(60), w)
        # Texts with the same longest word count once, so each has one of its own.
        words.append("ownlongestword" + "".join(chr(97 + int(d)) for d in f"{i:04d}"))
        rows.append((i, " ".join(words), "x"))
        marks.append((i, int(toxic), 1))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "vilewort foulterm grimslur " * 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic_score string")
    return docs, spark.createDataFrame(marks + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")


def test_toxicity(spark):
    docs, labels = toxic_tables(spark)
    got = {r["doc_id"]: r for r in toxicity.toxic_digest(docs, labels).collect()}
    assert len(got) == 403
    import zlib

    for i in range(400):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["predicted"] == (i % 5 == 0)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.7)
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and got[None]["predicted"] == 1
    nothing = toxicity.toxic_digest(docs, labels.limit(0))
    assert nothing.where("score > 0").count() == 0


def test_toxic_words_of_any_script():
    assert toxicity.words_of("“ПОДЛО” ÉTÉ—Ab1c 天地毒骂，x".encode()) == ["подло", "été", "ab", "c", "天地", "地毒", "毒骂", "x"]
    assert toxicity.units_of("Μισητός".encode())[1:] == ["μιση", "μισητ", "μισητό"]
    bad = ("подло", "гнусн", "毒骂", "été")
    tools = toxicity.Compressors(toxicity.Model(bad, ()))
    for text in ("ПОДЛО ГНУСНО ÉTÉ", "“подло” …гнусно—été", "天地毒骂人山 гнусно подло"):
        assert tools.measure(text.encode())[0] > 0, text
    assert tools.measure("天地人山 слово Όμορφος été".replace("été", "eté").encode())[0] <= 0


def test_toxic_cyrillic_capitals_are_found(spark):
    docs, labels = toxic_tables(spark)
    said = docs.select("doc_id", F.replace(F.replace(F.replace("text", F.lit("vilewort"), F.lit("подлослов")), F.lit("grimslur"), F.lit("гнусность")), F.lit("foulterm"), F.lit("скверна")).alias("text"))
    more = spark.createDataFrame([(2000, "ПОДЛОСЛОВ ГНУСНОСТЬ СКВЕРНА " * 3), (2001, "“подлослов” “гнусность” “скверна” " * 3)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxic_digest(said.unionByName(more), labels).collect()}
    assert got[2000] == got[2001] == 1 and got[1] == 0 and got[5] == 1


def test_pipeline_stages(spark, docs, tmp_path):
    tables = {
        "documents": docs.drop(*[c.split()[0] for c in fixture.EXTRA.split(", ")]),
        "labels": spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, rows_of(docs.where("doc_id = 20"))[0][1])], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    here = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, before = here.columns, here.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, here, str(tmp_path))
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        here = spark.read.parquet(f"{tmp_path}/{name}")
        assert here.count() <= before
        before = here.count()
    last = corpus_pipeline.STAGES[-1][1](spark, here, str(tmp_path))
    assert set(columns) | {"mix_taken"} <= set(last.columns)
    assert 20 not in {r["doc_id"] for r in last.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert fixture.plain(whole, "doc_id", "mix_taken") == fixture.plain(last, "doc_id", "mix_taken")
    assert last.where(F.col("mix_taken") <= 0).count() == 0


def test_line_lists_are_made_and_joined_by_token_range(spark, monkeypatch):
    from tillwatch.llm import lines

    ends = [(1 << 32) * k // lines.RANGES - (1 << 31) for k in range(lines.RANGES + 1)]
    edges = spark.createDataFrame([(t,) for e in ends for t in (e - 1, e) if -(1 << 31) <= t < 1 << 31], "token int")
    assert [r.n for r in edges.select(sum(c.cast("int") for c in lines.token_ranges()).alias("n")).collect()] == [1] * edges.count()

    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(words[:10] + [words[10 + i % 2]] + [f"x{i // 4}"])) for i in range(40)], "doc_id int, text string")
    names, got, keep = [], [], lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: names.append(name) or keep(df, name))
    for ranges in (1, 4):
        monkeypatch.setattr(lines, "RANGES", ranges)
        got.append(sorted(map(tuple, lines.line_digest(docs).collect())))
    assert got[0] == got[1] and sum(r[2] for r in got[0]) > 0
    assert names.count("lines-lists") == names.count("lines-met") == 5
