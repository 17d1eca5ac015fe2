"""The operators against brute force, exact round trips and hand-made cases on small fixtures."""

from __future__ import annotations

import collections
import dataclasses
import hashlib
import itertools
import math
import pathlib
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkgrid.sources.storage import shared_dir
from inkgrid.llm import blocks, extraction, forest, graph, kneser_ney, minhash, packing, pieces, ppm, privacy, quality, substrings, tables
from inkgrid.llm import queries as llm

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
EDGE = [(9000, None), (9001, ""), (9002, "one"), (9003, "One"), (9004, " \n\t "), (9005, "x " * 30000), (9006, "#% a b")]


def lowered(text):
    return (text or "").encode().translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256)))


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120).collect()
    return [tuple(r) for r in found] + EDGE


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "extra") for i, t in rows], "doc_id long, text string, lang string, id string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# ------------------------------------------------------------ 1


def test_ppm_matches_the_trie(spark, rows):
    rows = rows[:25] + [r for r in rows if r[0] >= 9000 and r[0] != 9005]
    trie, counts, docs = ppm.Trie(3), collections.Counter(), []
    for i, t in rows:
        b = lowered(t)
        words, held = [*WORD.findall(b), None], zlib.crc32(str(i).encode()) % 5 == 1
        docs.append((i, b, words, held))
        if not held:
            counts.update(words)
            history = (ppm.END,) * 3
            for s in [*b, ppm.END]:
                trie.learn(history, s)
                history = (*history, s)[1:]
    n, v = sum(counts.values()), len(counts)
    want = {i: (held, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), trie.score(b, False)) for i, b, w, held in docs}
    got = ppm.scores(frame(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 5 == 1, 3).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4]) and r["score"] == pytest.approx(w[5])


def test_ppm_probabilities_add_up_and_adaptive_mode(spark):
    trie = ppm.Trie(2)
    trie.score(b"abracadabra", True)
    for history in ((256, 256), (97, 98), (1, 2), (98, 114)):
        assert sum(10 ** trie.cost(history, s) for s in range(257)) <= 1 + 1e-9
    got = ppm.adaptive_scores(spark.createDataFrame([(1, "aaaaaaaaaa"), (2, None)], "doc_id long, text string"), 2).collect()
    assert got[0]["score"] > -10 * math.log10(257) and got[1]["score"] == pytest.approx(-math.log10(257))
    assert ppm.scores(empty(spark), F.lit(False)).count() == 0


def test_ppm_loads_what_it_uses(tmp_path):
    """A new worker gets its rows as a stream, and nothing else in it has loaded pyarrow.compute (as pandas, and pa.array, would)."""
    import pyarrow as pa
    import zstandard

    def stream(columns):
        sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_pydict(columns)
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        return sink.getvalue().to_pybytes()

    body = zstandard.ZstdCompressor().compress(stream({"held": [True, False], "text": ["held", "learnt"]}))
    (tmp_path / "rows").write_bytes(stream({"body": [body]}))
    code = """
import sys, pyarrow as pa
from inkgrid.llm import ppm
for batch in pa.ipc.open_stream(pa.OSFile(sys.argv[1])):
    for data, offsets in ppm._training(batch.column(0)):
        print(data.tobytes().decode()[offsets[0] : offsets[-1]])
"""
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path / "rows")], capture_output=True, text=True)
    assert done.stdout == "learnt\n", done.stderr


def test_long_texts_are_coded_in_parts(monkeypatch):
    texts = ["one two  three", "", "a" * 40 + " b", " ", "x y z " * 9, "end"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])

    def found():
        codes = [(c, r, s) for c, r, s in ppm._codes(*ppm._symbols(data, offsets), 5)]
        words = [(c, r, s) for c, r, s in ppm._words(data, offsets)]
        out = []
        for parts in (codes, words):
            rows = [[] for _ in texts]
            for values, r, size in parts:
                at = np.cumsum([0, *size])
                for i in range(len(size)):
                    rows[r + i] += values[at[i] : at[i + 1]].tolist()
            out.append(rows)
        return out

    whole = found()
    for step in (1, 3, 7, 16):
        monkeypatch.setattr(ppm, "STEP", step)
        monkeypatch.setattr(ppm, "chunks", lambda o: ((i, i + 1) for i in range(len(o) - 1)))
        assert found() == whole


def test_blocks_are_bounded_and_whole(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i * 37 % 900) for i in range(50)])], names=["i", "t"])
    parts = list(blocks.cut(batch, 2000, 16))
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches([batch]).to_pylist()
    assert all(p.num_rows == 1 or (p.nbytes <= 2000 and p.num_rows <= 16) for p in parts)
    df = spark.range(0, 3000, 1, 7).select("id", F.repeat(F.lit("y"), (F.col("id") % 90).cast("int")).alias("t"))
    stored = blocks.packed(df, lambda b: b, 200_000, 20_000).collect()
    assert len({r["block"] for r in stored}) == len(stored) > 5
    ids = [i for r in stored for b in blocks.opened(pa.array([r["body"]], pa.binary())) for i in b.column(0).to_pylist()]
    assert sorted(ids) == list(range(3000))


def test_squeezed_numbers_come_back():
    rng = np.random.default_rng(1)
    for values, ascending in ((np.sort(rng.integers(0, 1 << 54, 500)), True), (rng.normal(size=300), False), (np.zeros(0, np.int64), True), (rng.integers(0, 99, 7).astype(np.uint32), False)):
        assert (blocks.unsqueezed(blocks.squeezed(values, ascending), values.dtype.type, ascending) == values).all()


# ------------------------------------------------------------ 2


def similar(rows, size):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lowered(t))
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def family(n=160):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(120)] for _ in range(3)]
    out = []
    for i in range(n):
        words = list(base[i % 3])
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(120)] = f"z{rng.randint(0, 10**6)}"
        out.append((i, " ".join(words)))
    return out + EDGE[:5]


@pytest.mark.parametrize(("size", "change"), [(2, {}), (5, {}), (2, {"few": 4, "block": 32})])
def test_near_duplicates_match_all_pairs(spark, rows, size, change):
    data = family() if size == 2 else rows
    got = minhash.near_duplicates(frame(spark, data), dataclasses.replace(minhash.Settings(shingle=size), **change)).collect()
    assert sorted(map(tuple, got)) == similar(data, size)


def test_near_misses_of_a_family_make_no_rows(spark, monkeypatch):
    rng = random.Random(9)
    base, data = [f"w{k}" for k in range(400)], []
    for i in range(100):  # any two at about 0.77
        words = list(base)
        for k in rng.sample(range(400), 13):
            words[k] = f"z{i}y{k}"
        data.append((i, " ".join(words)))
    asked, confirm = [], minhash.confirm

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(minhash, "confirm", counted)
    got = minhash.near_duplicates(frame(spark, data), minhash.Settings(shingle=2, few=8)).collect()
    assert sorted(map(tuple, got)) == similar(data, 2) and sum(asked) < 2_000  # of 4,950 pairs


def test_near_duplicates_of_nothing_repeated_rows_and_shared_ids(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    got = minhash.near_duplicates(frame(spark, [(2, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f")])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(1, 1, True), (2, 1, False), (2, 1, False)]
    rows = [(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (4, "u v w x y z"), (5, "u v w x y z"), (6, "a b c d e f"), (5, "")]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted([(-1, 2, -1, True), (-1, 0, -1, True), (5, 2, 4, False), (4, 2, 4, True), (5, 2, 4, False), (6, 2, 4, False), (5, 0, 5, True)])


def test_hubs_are_joined_in_parts(spark):
    left = spark.range(5000).select((F.col("id") * F.col("id") % 7).alias("k"), "id").union(spark.range(20000).select(F.lit(1).alias("k"), "id"))
    right = spark.range(7).select(F.col("id").alias("k"), (F.col("id") + 10).alias("v"))
    out = tables.hub_join(left, right, "k", left)
    assert "__part" not in out.columns and out.count() == 25000 and out.filter("v <> k + 10").count() == 0


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (3, 2)], "a long, b long")
    assert {r["id"]: r["component"] for r in graph.components(links).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# ------------------------------------------------------------ 3


def test_forest_recall_and_exact_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    got = forest.neighbours(df, F.col("vec_id") % 20 == 0).collect()
    data = df.collect()
    ids, x = np.array([r[0] for r in data]), np.array([r[1] for r in data], float)
    found = collections.defaultdict(dict)
    for r in got:
        found[r["query_id"]][r["vec_id"]] = r["score"]
    hits = 0
    asking = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    for i in asking:
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        hits += sum(ids[j] in found[ids[i]] for j in order)
        assert all(abs(v - float(x[list(ids).index(k)] @ x[i])) < 1e-9 for k, v in found[ids[i]].items()) and len(found[ids[i]]) == 20
    assert hits >= 0.9 * 20 * len(asking)


def test_forest_edge_cases(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [0.5, 0.5]), (7, [1.0, 0.0, 0.0]), (20, [2.0, 0.0])]
    df = spark.createDataFrame([(i, x, "a") for i, x in v], "vec_id long, embedding array<float>, id string")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in forest.neighbours(df, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 1), (0, 3, 2), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert forest.neighbours(df.filter("vec_id < 0"), F.lit(True)).count() == 0


# ------------------------------------------------------------ 4


def test_pieces_match_the_library(spark, rows):
    import sentencepiece

    path = pieces.model_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    data = rows + [(9100, "  two  spaces "), (9101, "a▁b 한글 ÿ\x00\n")]
    got = pieces.encode(frame(spark, data), path, ("ids", "begins", "ends", "decoded", "ids_sha256", "n_source_bytes")).collect()
    texts = {i: t or "" for i, t in data}
    for r in got:
        t = texts[r["doc_id"]]
        ids = sp.encode(t, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == sp.decode(ids) and r["n_source_bytes"] == len(t.encode())
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert b"".join(t.encode()[a:b] for a, b in zip(r["begins"], r["ends"])) == t.encode()
    again = pieces.decode(spark.createDataFrame([(got[0]["ids"],), (None,)], "ids array<int>"), path).collect()
    assert again[0]["decoded"] == sp.decode(got[0]["ids"]) and again[1]["decoded"] is None


def test_compiled_map_matches_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    mine = pieces.Normaliser(library.serialized_model_proto())
    rng, signs = random.Random(1), list("aB ﬁ①ＡＢ㌔  カ゛é́½™\t\n한글▁x ñ�")
    for _ in range(400):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        out, source = mine(t.encode())
        assert out.decode() == library.normalize(t) and len(source) == len(out) + 1 and (np.diff(source) >= 0).all()


def test_spans_of_a_mapped_model_through_the_operator(spark, tmp_path):
    import sentencepiece

    mapped = sentencepiece.SentencePieceNormalizer(rule_name="nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True).serialized_model_proto()
    path = tmp_path / "mapped.model"
    path.write_bytes(open(pieces.model_path("piece_bpe_32k.model"), "rb").read() + mapped)  # later fields of a message replace earlier ones
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert sp.encode("ﬁ") == sp.encode("fi") and pieces.Normaliser(path.read_bytes()).units
    rng, signs = random.Random(4), list("aB ﬁ①ＡＢ㌔  カ゛é́½™\t\n한글x ñ")
    texts = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 16)))) for i in range(200)] + EDGE[:5]
    for r in pieces.encode(frame(spark, texts), str(path), ("ids", "begins", "ends")).collect():
        t = r["text"] or ""
        found = sp.encode(t, return_type="proto").pieces
        assert r["ids"] == [*(p.id for p in found), sp.eos_id()]
        b = t.encode()
        want = [b[p.begin : p.end].strip() for p in found]
        assert [b[x:y].strip() for x, y in zip(r["begins"], r["ends"])][:-1] == want and r["ends"][-1] == len(b)


# ------------------------------------------------------------ 5


def test_quality_matches_sql(spark, duck, sf_dir):
    got = quality.op5(spark, sf_dir)
    rel = duck.sql(llm.ORACLES["op5_quality_rules"])
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall()) and list(rel.columns) == got.columns


def test_quality_references_are_counted_from_all_trusted_texts(spark):
    n = 4_001
    docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id, ' x') as text", "'en' as lang")
    labels = docs.selectExpr("doc_id", "1 as quality")
    (r,) = quality.references(docs, labels, common=n + 1).collect()
    assert len(r["ref_words"]) == n + 1 and r["ref_words"][0] == "x" and r["ref_shares"][0] == pytest.approx(0.5)
    assert set(r["ref_shares"][1:]) == {1 / (2 * n)}


def test_quality_edge_cases(spark):
    got = {r["doc_id"]: r for r in quality.quality_rules(frame(spark, EDGE)).collect()}
    assert got[9000]["n_words"] == 0 and got[9000]["base_failed"] and got[9000]["class_divergence"] is None and got[9000]["id"] == "extra"
    assert got[9005]["n_repeat_words"] == got[9005]["n_words"] == 30000 and got[9006]["n_symbols"] == 2
    strange = spark.createDataFrame([(1, "word " * 7 + " ".join(f"w{i}" for i in range(60)), None)], "doc_id long, text string, lang string")
    assert quality.quality_rules(strange).first()["kept"]
    assert quality.keep_good(empty(spark)).columns == ["doc_id", "text", "lang"]


def test_references_count_trusted_texts(spark):
    docs = frame(spark, [(1, "The the of. "), (2, "of THE a"), (3, "not trusted"), (4, None)])
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 1), (3, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    (r,) = quality.references(docs, labels, common=2).collect()
    assert (r["ref_lang"], r["ref_words"], r["ref_shares"]) == ("en", ["the", "a"], [3 / 6, 1 / 6])
    assert r["ref_classes"][0] == 10 / 20 and sum(r["ref_classes"]) == pytest.approx(1)
    judged = quality.quality_rules(docs, quality.references(docs, labels)).collect()
    assert len(judged) == 4 and judged[0]["word_divergence"] is not None and quality.references(docs, labels.filter("quality > 1")).count() == 0


@pytest.mark.parametrize("window", [2, 3, 5, 8])
def test_repeated_words_of_any_window(spark, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("w", F.filter(F.split("text", " "), lambda x: x != ""))
    got = {r["id"]: r["n"] for r in quality.window_hashes(df, "w", window, "h").select("id", quality.repeat_words(F.col("h"), window).alias("n")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        runs = [tuple(w[j : j + window]) for j in range(len(w) - window + 1)]
        covered = {j + k for j, r in enumerate(runs) if runs.count(r) > 1 for k in range(window)}
        assert got[i] == len(covered)


# ------------------------------------------------------------ 6


def test_surrogates_keep_type_format_and_coreference(spark):
    text = "Dr. Maria Lopez wrote to ann.5@mail.example.com; Lopez called +1 (017) 555-7713 from 97.51.17.173. token = \"04dbebab91ab85687d33eeaaf9ac699e\" 4111 1111 1111 1111"
    rows = [(1, text), (2, "ANN.5@mail.example.com and 4111111111111111"), (3, None), (4, "plain words 12")]
    got = {r["doc_id"]: r for r in privacy.replace_private(frame(spark, rows), b"k").collect()}
    new = got[1]["text"]
    for secret in ("Lopez", "ann.5@", "555-7713", "97.51.17.173", "04dbebab", "4111"):
        assert secret not in new
    assert got[1]["n_entities"] == 7 and got[3]["text"] is None and got[4]["text"] == "plain words 12" and got[4]["n_entities"] == 0
    mail = re.search(r"\S+@\S+\.(?:com|net|org)", new)[0]
    assert got[2]["text"].startswith(mail)
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}$", new)[0].replace(" ", "")
    assert got[2]["text"].endswith(card) and privacy._luhn(card)
    assert privacy.surrogate("PERSON", "Anna Berg", b"k", 0, "f").split()[0] in privacy.NAMES["LATIN", "f"].split()


def test_surrogates_stay_distinct_and_full_classes_end(spark):
    rows = [("PERSON", f"Ann{i} Name{i}", "f" * (i % 2)) for i in range(200)] + [("SSN", "123456789", "")] + [("EMAIL", f"{chr(97 + i % 26)}@{chr(97 + i // 26)}.org", "") for i in range(2500 // 4)] + [("PHONE", f"{i}", "") for i in range(10)]
    got = privacy.assigned(spark.createDataFrame(rows, "kind string, canonical string, gender string"), b"k").collect()
    assert len({(r["kind"], privacy.visible(r["kind"], r["surrogate"])) for r in got}) == len(got) == len(rows)
    assert not {(k, privacy.visible(k, c)) for k, c, _ in rows} & {(r["kind"], privacy.visible(r["kind"], r["surrogate"])) for r in got}


def replaced_by_hand(texts, key):
    """Entities one after another, each with the first surrogate that nothing else has."""
    real, order = set(), {}
    for t in texts:
        for e in privacy.entities(t or ""):
            real.add((e.kind, privacy.visible(e.kind, e.canonical)))
            order[e.kind, e.canonical] = max(order.get((e.kind, e.canonical), ""), e.gender)
    new, attempt = {}, dict.fromkeys(order, 0)
    while True:
        for (k, c), n in attempt.items():
            new[k, c] = privacy.surrogate(k, c, key, n, order[k, c])
        seen = collections.defaultdict(list)
        for (k, c), x in new.items():
            seen[k, privacy.visible(k, x)].append((attempt[k, c], c))
        again = {(k, c) for (k, v), who in seen.items() for _, c in (who if (k, v) in real else sorted(who)[1:])}
        if not again:
            break
        for e in again:
            attempt[e] += 1
    out = []
    for t in texts:
        for e in reversed(privacy.entities(t or "")):
            t = t[: e.start] + privacy.written(e, t[e.start : e.end], new[e.kind, e.canonical]) + t[e.end :]
        out.append(t)
    return out


def test_replacing_matches_one_text_after_another(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "Mr. Paul Ost met Dr. Paul Ost; Ost left. a@b.org"), (None, "Frau Ost, A@B.org"), *EDGE[:4], (rows[0][0], rows[0][1])]
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in privacy.replace_private(frame(spark, rows), b"k").collect())
    assert got == sorted((i or -1, t or "") for (i, _), t in zip(rows, replaced_by_hand([t for _, t in rows], b"k")))
    assert privacy.replace_private(empty(spark), b"k").count() == 0


def test_long_local_parts_and_far_names_are_found_whole():
    text = "x" * 80 + "@mail.org and secret" + " " * 60 + "= " + "Abc123def456ghi"
    assert [(e.kind, text[e.start : e.end]) for e in privacy.entities(text)] == [("EMAIL", "x" * 80 + "@mail.org"), ("SECRET", "Abc123def456ghi")]


# ------------------------------------------------------------ 7


def brute_cut(worths, edges):
    best = min(range(1 << len(worths)), key=lambda m: (round(sum(abs(w) for i, w in enumerate(worths) if (w > 0) != bool(m >> i & 1)) + sum(c for a, b, c in edges if (m >> a & 1) != (m >> b & 1)), 9)))
    return sum(abs(w) for i, w in enumerate(worths) if (w > 0) != bool(best >> i & 1)) + sum(c for a, b, c in edges if (best >> a & 1) != (best >> b & 1))


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        worths = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, i + 1, rng.uniform(0, 1.5)) for i in range(n - 1)] + [(i, i + 2, rng.uniform(0, 1)) for i in range(n - 2)]
        got = extraction.minimum_cut(worths, edges)
        cost = sum(abs(w) for w, k in zip(worths, got) if (w > 0) != k) + sum(c for a, b, c in edges if got[a] != got[b])
        assert cost == pytest.approx(brute_cut(worths, edges))


def test_extraction(spark, sf_dir):
    page = '<html><head><title>T</title></head><body><header>Site</header><nav><a href="/">Home page</a></nav><div class="ad">Buy this now, it is cheap.</div><article><h1>Head &amp; line</h1><p>First  <b>bold</b>\ntext, with words.<br>More.<p>Second.</article><div class="comments"><p>I like it very much.</p></div><footer>&copy; x</footer></body></html>'
    df = spark.createDataFrame([(1, page, "u"), (2, None, "u"), (3, "", "u"), (4, "just text <", "u")], "page_id long, html string, url string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(df).collect()}
    assert got[1] == "Head & line\n\nFirst bold text, with words. More.\n\nSecond." and got[2] == got[3] == ""
    out = extraction.op7(spark, sf_dir)
    assert out.columns == ["page_id", "url", "text", "n_chars", "n_blocks", "n_moved"] and out.filter("n_chars = 0").count() == 0
    assert extraction.extract(df.filter("page_id < 0")).count() == 0
    assert extraction.fit(df.filter("page_id > 1")) == extraction.fit(df.filter("page_id < 0")) == extraction.WEIGHTS  # no block whose elements say what it is
    one, many = extraction.fit(df), extraction.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    apart = lambda w: max(abs(x - y) for x, y in zip(w, extraction.WEIGHTS))
    assert 0 < apart(one) < 2 and len(many) == len(one) and all(math.isfinite(x) for x in many)


# What a reader would take from each page, written down by hand.
PAGES = [
    ('<body><div id="cookie-notice"><p>We use cookies to make this site work, and to learn what is read. Choose below what you allow us to keep, and for how long we may keep it.</p><button>Yes</button></div><main><h1>A title</h1><p>Yes.</p><p>The first paragraph has more words, and ends here.</p><ul><li>Milk</li><li>Eggs</li><li>Two cups of flour</li></ul><p>No.</p></main><aside><p>Also of note, on another page.</p></aside></body>',
     "A title\n\nYes.\n\nThe first paragraph has more words, and ends here.\n\nMilk\n\nEggs\n\nTwo cups of flour\n\nNo."),
    ('<header><a href="/">Home</a></header><div class="content"><h2>News</h2><p>Something happened, and it was said to be new.</p><div class="share"><a href="#">Tell</a> <a href="#">Print</a></div><p>Later it was old.</p></div><div id="comments"><article class="comment"><p>I read all of this, and I think that it was well put, though the end came too soon for me. Thank you for writing it, and please go on.</p></article></div>',
     "News\n\nSomething happened, and it was said to be new.\n\nLater it was old."),
    ("<div><div><p>Without any names, a page has only its words to go by, and these are many, in whole sentences. They go on for a while.</p><p>Short.</p><p>Then there is one more paragraph, in which the same is said again, with other words.</p></div><div><a href='a'>One</a> <a href='b'>Two</a> <a href='c'>Three</a></div></div>",
     "Without any names, a page has only its words to go by, and these are many, in whole sentences. They go on for a while.\n\nShort.\n\nThen there is one more paragraph, in which the same is said again, with other words."),
    ("<article><p>Of.</p></article><footer>x</footer>", "Of."),
    ("<p>a &lt;b&gt; &amp;amp; c&nbsp;d</p> tail <!-- gone", "a <b> &amp; c d\n\ntail"),
    ("<script>var a = '<p>no</p>'; //", ""),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages_labelled_by_hand(page, want):
    assert extraction.main_text(page) == want


def test_the_cut_overrules_what_a_block_is_worth_alone():
    found, worths, kept = extraction.labelled("<div>" + "<p>A paragraph with a good number of words in it, as an article has them, and more after that. And then some.</p>" * 2 + "<p>No</p>" + "<p>And after the short one the text goes on, with words enough to be told from a menu of links. Here it ends.</p></div>", (-1.0, 2.0, -4.0, 1.0, 1.0, -4.0))
    assert worths[2] < 0 and kept == [True] * 4


@pytest.mark.parametrize("part", ["<a ", '<a "', '<a ">" ', "<a<a", "<!--", "<script", "<div></x>", "<p>some words, and more of them.</p><p><a>x</a></p>"])
def test_hostile_markup_takes_linear_time(part):
    import time

    began = time.process_time()
    extraction.main_text(part * (300_000 // len(part)) + ">")
    assert time.process_time() - began < 3


@pytest.mark.parametrize("around", ['<body class="has-sidebar">{}', '<body class="search"><div>{}</div>', '<div id="main" class="no-sidebar">{}</div>', '<article class="ad-free">{}</article>', '<article class="post tag-legal">{}</article>', '<div class="widget"><main>{}</main></div>', '<div class="widget"><div class="content">{}</div></div>', '<form><article>{}</article></form>'])
def test_a_hint_around_does_not_lose_the_article(around):
    text = "A paragraph of the article, with enough words in it to be told from a menu. " * 3
    assert extraction.main_text(around.format(f'<p>{text}</p><div class="ad">Buy this now.</div>')) == text.strip()


def test_long_text_outweighs_a_hint_but_short_does_not():
    long = "Words of a long passage that no link is in, one after another. " * 12
    assert extraction.main_text(f'<div class="related"><p>{long}</p></div>') == long.strip()
    for page in ('<div class="related"><p>Read this as well, please.</p></div>', f'<div class="related"><a href="/">{long}</a></div>', f'<nav class="content"><p>{long}</p></nav>', f'<div hidden><article><p>{long}</p></article></div>', '<div class="sidebar-content"><p>Short words.</p></div>'):
        assert extraction.main_text(page) == ""


# ------------------------------------------------------------ 8


def cut_spans(rows, window):
    first, docs = {}, {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(docs):
        for p in range(len(docs[i]) - window + 1):
            first.setdefault(tuple(docs[i][p : p + window]), i)
    out = []
    for i, w in docs.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def test_repeated_spans_match_brute_force(spark, rows):
    rng = random.Random(3)
    tiny = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(100 + i, "x y " * rng.randint(0, 40)) for i in range(10)] + EDGE[:5]
    assert sorted(map(tuple, substrings.remove_repeats(frame(spark, tiny), 6, 3, with_text=False).collect())) == cut_spans(tiny, 6)
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == cut_spans(rows, 50)
    assert {r["id"] for r in got} == {"extra"} and substrings.remove_repeats(empty(spark)).count() == 0


def test_texts_with_one_id_and_null_ids_are_told_apart(spark):
    words = [" ".join(f"{c}{i}" for i in range(80)) for c in "abc"]
    rows = [(1, words[0]), (2, words[0]), (2, words[1]), (3, words[2]), (3, words[2]), (4, words[2]), (None, words[0]), (None, words[0])]
    got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in substrings.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted([(1, words[0], 0), (2, "", 80), (2, words[1], 0), (3, words[2], 0), (3, words[2], 0), (4, "", 80), (0, words[0], 0), (0, words[0], 0)])


def test_paths_end_where_the_graph_branches(spark):
    edge = lambda i, head, tail, start: (0, i, head, tail, 1, (1, 0, 0, start))
    rows = [edge(1, 1, 2, 0), edge(2, 2, 3, 1), edge(3, 3, 4, 2), edge(4, 4, 5, 3), (0, 5, 3, 9, 1, (1, 0, 1, 7)), edge(6, 5, 6, 5)]
    edges = spark.createDataFrame(rows, "anchor long, body long, head int, tail int, n int, s struct<id:long,block:long,row:int,start:int>")
    got = {r["body"]: r["path"] for r in substrings.compacted(edges).collect()}
    assert got == {1: 0, 2: 0, 3: 2, 4: 2, 5: 7, 6: 5}  # node 3 has two ways out; edge 6 doesn't follow edge 4


# ------------------------------------------------------------ 9


def test_kneser_ney_probabilities_and_order(spark):
    rng = random.Random(6)
    common = [f"w{i}" for i in range(60)]
    good = [(i, " ".join(rng.choice(common[: 10 + i % 50]) for _ in range(60))) for i in range(80)]
    junk = [(1000 + i, " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(10)]
    docs = frame(spark, good + junk + EDGE[:3])
    labels = spark.createDataFrame([(i, 1) for i, _ in good], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in kneser_ney.classify(docs, labels).collect()}
    assert len(got) == 93 and not any(got[i]["kept"] for i, _ in junk) and sum(got[i]["kept"] for i, _ in good) >= 76
    assert got[9000]["n_tokens"] == 1
    nothing = kneser_ney.classify(docs, labels.filter("doc_id < 0")).collect()
    assert all(r["kept"] for r in nothing)
    model = kneser_ney.Model(docs.filter("doc_id < 80"))
    assert sum(model.unigrams) == pytest.approx(1, abs=0.02)


def test_empty_tables(spark):
    path = pieces.model_path("piece_bpe_32k.model")
    assert pieces.encode(empty(spark), path).count() == 0
    assert kneser_ney.classify(empty(spark), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_languages_go_with_their_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en"), (1, "a b c d", "de"), (2, "a b", None)], "doc_id long, text string, lang string")
    got = kneser_ney.classify(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert sorted((r["doc_id"], r["lang"] or "") for r in got) == [(1, "de"), (1, "en"), (2, "")]


def kneser_ney_by_hand(trusted, texts):
    """log10 probabilities in dictionaries; every trusted word is in the vocabulary."""
    split = lambda t: [*WORD.findall(lowered(t)), "end"]
    trigrams = lambda w: zip(["start", "start", *w], ["start", *w], w)
    c3 = collections.Counter(g for t in trusted for g in trigrams(split(t)))
    c2 = collections.Counter()
    for (_, v, w), n in c3.items():
        c2[v, w] += n if v == "start" else 1
    c1 = collections.Counter(w for _, w in c2)
    known = {w for t in trusted for w in split(t)} - {"end"}
    size = len(known) + 3

    def discounts(c):
        n1, n2, n3, n4 = (sum(x == k for x in c.values()) for k in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        d = [min(max(x, 0.05), cap) for x, cap in zip(d, (0.95, 1.95, 2.95))]
        return lambda n: d[min(n, 3) - 1]

    d1, d2, d3 = discounts(c1), discounts(c2), discounts(c3)

    def contexts(c, d):
        all_, cut = collections.Counter(), collections.Counter()
        for g, n in c.items():
            all_[g[:-1]] += n
            cut[g[:-1]] += d(n)
        return all_, cut

    (a2, k2), (a3, k3) = contexts(c2, d2), contexts(c3, d3)
    total, cut = sum(c1.values()), sum(d1(n) for n in c1.values())

    def p(u, v, w):
        one = (max(c1[w] - d1(c1[w]), 0) if c1[w] else 0) / total + cut / total / size
        two = one if not a2[(v,)] else (max(c2[v, w] - d2(c2[v, w]), 0) if c2[v, w] else 0) / a2[(v,)] + k2[(v,)] / a2[(v,)] * one
        if not a3[u, v]:
            return two
        return (max(c3[u, v, w] - d3(c3[u, v, w]), 0) if c3[u, v, w] else 0) / a3[u, v] + k3[u, v] / a3[u, v] * two

    out = {}
    for i, t in texts:
        w = [x if x in known or x == "end" else None for x in split(t)]
        out[i] = (len(w), sum(math.log10(p(*g)) for g in trigrams(w)) - w.count(None) * math.log10(kneser_ney.OTHER_WORDS))
    return out


def test_kneser_ney_matches_dictionaries(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(0, 40)))) for i in range(90)] + EDGE[:5]
    docs = frame(spark, texts)
    want = kneser_ney_by_hand([t for i, t in texts if i < 40], texts)
    got = kneser_ney.perplexities(docs, kneser_ney.Model(docs.filter("doc_id < 40"))).collect()
    assert len(got) == len(want)
    for r in got:
        n, log = want[r["doc_id"]]
        assert r["n_tokens"] == n and r["log10_probability"] == pytest.approx(log, rel=1e-5) and r["perplexity"] == pytest.approx(10 ** (-log / n), rel=1e-4)


def test_kneser_ney_has_every_word_of_its_sample(spark, monkeypatch):
    texts = [(i, " ".join([*(f"w{i}x{k}" for k in range(1000)), *(f"v{i // 2}y{k}" for k in range(4))])) for i in range(90)]  # more words than 16 bits number
    docs = frame(spark, texts)
    model = kneser_ney.Model(docs)
    assert len(model.vocabulary) == 90_180 and sorted(model.of) == list(range(kneser_ney.FIRST, kneser_ney.FIRST + 90_180))
    want = kneser_ney_by_hand([t for _, t in texts], texts[:2])
    got = {r["doc_id"]: r["log10_probability"] for r in kneser_ney.perplexities(docs.filter("doc_id < 2"), model).collect()}
    assert all(got[i] == pytest.approx(want[i][1], rel=1e-5) for i in (0, 1))
    monkeypatch.setattr(kneser_ney, "MOST", 3500)  # whole texts in the order of their hashes, as long as they fit
    model = kneser_ney.Model(docs)
    drawn = docs.select("text").orderBy(F.xxhash64("text")).limit(3)
    few = kneser_ney.Model(drawn)
    assert 3000 < len(model.vocabulary) < 3500 and (model.vocabulary == few.vocabulary).all()
    monkeypatch.setattr(kneser_ney, "MOST", 999)  # not one text fits
    assert len(kneser_ney.Model(docs).vocabulary) == 0 and kneser_ney.perplexities(docs, kneser_ney.Model(docs)).count() == 90


def test_kneser_ney_is_trained_on_all_trusted_texts(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "MOST", 50)  # bounds samples only
    texts = [(i, " ".join([f"w{i}", *(f"v{i // 2}y{k}" for k in range(3))])) for i in range(6_000)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1) for i, _ in texts], "doc_id long, quality int")
    held = {r[0] for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.HELD_OUT)) == 0).select("doc_id").collect()}
    got = {r["doc_id"]: r["log10_probability"] for r in kneser_ney.classify(docs, labels).collect()}
    want = kneser_ney_by_hand([t for i, t in texts if i not in held], texts)
    assert len(texts) - len(held) > 4_500 and all(got[i] == pytest.approx(want[i][1], rel=1e-5) for i, _ in texts)


def test_kneser_ney_in_slices_leaves_no_tables(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SLICE", 1 << 12)
    monkeypatch.setattr(kneser_ney, "ROWS", 1 << 9)
    rng = random.Random(9)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(0, 80)))) for i in range(300)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    held = {r[0] for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(kneser_ney.HELD_OUT)) == 0).select("doc_id").collect()}
    folder = pathlib.Path(shared_dir(spark))
    before = set(folder.rglob("*.parquet"))
    got = {r["doc_id"]: r["log10_probability"] for r in kneser_ney.classify(docs, labels).collect()}
    want = kneser_ney_by_hand([t for i, t in texts if i < 200 and i not in held], texts)
    assert len(got) == 300 and all(got[i] == pytest.approx(want[i][1], rel=1e-5) for i, _ in texts)
    left = [x for x in set(folder.rglob("*.parquet")) - before if x.parent.exists()]
    assert left and all(set(spark.read.parquet(str(x)).columns) == {"doc_id", "lang", "n_tokens", "log10_probability"} for x in left)  # the scores only


def test_kneser_ney_hashes_as_spark_does(spark):
    rows = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, (50, 3))
    df = spark.createDataFrame(rows.tolist(), "u long, v long, w long")
    got = [tuple(r) for r in df.select(F.xxhash64("u"), F.xxhash64("u", "v"), F.xxhash64("u", "v", "w")).collect()]
    u, v, w = (np.ascontiguousarray(rows[:, i]) for i in range(3))
    assert got == list(zip(kneser_ney.hashed(u).tolist(), kneser_ney.hashed(u, v).tolist(), kneser_ney.hashed(u, v, w).tolist()))


def test_slices_do_not_move_the_model_again(spark):
    """The model's table is read in the buckets it was stored in, gives the same answers, and is gone when it isn't needed."""
    texts = spark.createDataFrame([(f"a b c{i % 7} d e{i}",) for i in range(200)], "text string")
    model = kneser_ney.Model(texts, whole=True)
    grouped = model.table.groupBy("shard").applyInArrow(lambda t: t.select(["shard"]), "shard int")
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert grouped.distinct().count() == model.shards
    model.forget()
    assert not spark.catalog.tableExists(model.name)


def test_questions_and_tables_are_in_the_order_of_word_hashes():
    """So what is looked for one after the other is near, and hashes are sent by their steps."""
    rng = np.random.default_rng(5)
    rows = [np.append(rng.integers(3, 40, k) * -(1 << 57) + rng.integers(0, 3, k), kneser_ney.STOP) for k in (0, 1, 2, 3, 200, 0, 1)]
    texts = [(*kneser_ney.vocabulary(np.concatenate(part)), np.array([len(r) for r in part])) for part in (rows[:4], rows[4:])]
    each = [g for r in rows for g in zip([kneser_ney.START] * 2 + r.tolist(), [kneser_ney.START] + r.tolist(), r.tolist())]
    words, v, u, w, n, back = kneser_ney.distinct(texts, back=True)
    assert (np.diff(words) > 0).all() and list(zip(v, u, w)) == sorted(set(zip(v, u, w)))
    assert [tuple(words[x[i]].item() for x in (u, v, w)) for i in back] == each
    assert dict(zip(zip(*(words[x].tolist() for x in (u, v, w))), n.tolist())) == collections.Counter(each)
    assert all((x == y).all() for x, y in zip(kneser_ney.distinct(texts)[1:], (v, u, w, n)))
    body = pa.py_buffer(kneser_ney.coded(words, v, u, w, n))
    used, *numbers = kneser_ney.decoded(body)
    assert (np.diff(used) > 0).all() and all((used[x] == words[y]).all() for x, y in zip(numbers, (v, u, w))) and (numbers[3] == n).all()
    asked = kneser_ney.Questions(texts, words[3:5], 4)
    for (kind, _), at in asked.of.items():
        keys = words[at] if kind == 1 else asked.bv[at] << 31 | asked.bw[at] if kind == 2 else asked.v[at] << 42 | asked.u[at] << 21 | asked.w[at]
        assert (np.diff(keys) > 0).all()
    both = kneser_ney.together(pa.chunked_array([[body.to_pybytes()] * 2]))
    assert (both[0] == used).all() and (both[4] == 2 * n).all()


def test_counts_are_shuffled_for_some_shards_at_a_time(spark, monkeypatch):
    """However many goes the shards are dealt in, each has its trigrams once, and what is shuffled at once is for some of the shards."""
    texts = spark.createDataFrame([(f"a b c{i % 7} d e{i} f{i % 31}",) for i in range(400)], "text string")
    tables, shuffled = [], []
    keep = kneser_ney.stored_once

    def watched(df, by=None):
        out = keep(df, by)
        if by:
            shuffled.append({r[0] for r in out.filter("kind = 3").select("shard").collect()})
        return out

    monkeypatch.setattr(kneser_ney, "stored_once", watched)
    for goes in (1, 2, 3):
        shuffled.clear()
        monkeypatch.setattr(kneser_ney, "GOES", goes)
        model = kneser_ney.Model(texts, whole=True)
        tables.append(sorted((r["shard"], r["kind"], bytes(r["body"]), r["stats"]) for r in model.table.collect()))
        model.forget()
        some = [x for x in shuffled if x]
        assert len(some) == goes and sum(map(len, some)) == len(set().union(*some)) == model.shards
    assert tables[0] == tables[1] == tables[2]


def test_numbers_of_four_bytes_come_back():
    for x in (np.array([0, 1, 255, 256, 65_537, (1 << 32) - 1], np.uint32), np.array([0.1, np.nan, -np.inf, 3e38], np.float32), np.zeros(0, np.float32)):
        got = blocks.unsqueezed(blocks.squeezed(x), x.dtype.type)
        assert got.dtype == x.dtype and got.tobytes() == x.tobytes()


def test_grams_are_looked_for_among_known_contexts():
    table = np.array([0 << 31 | 3, 0 << 31 | 5, 2 << 31 | 0])
    context, word = np.array([0, 0, -1, 2, 2, 0]), np.array([5, 4, 5, 0, -1, 3])
    assert kneser_ney.among(table, context, word).tolist() == [1, -1, -1, 2, -1, 0]
    assert kneser_ney.among(table[:0], context, word).tolist() == [-1] * 6


# ------------------------------------------------------------ 10


def test_words_that_come_again_are_encoded_once():
    t = packing.Tokens(packing.model_path("word_bpe_49k.json"))
    made = []
    t.words.make = lambda word: made.append(word) or word
    text = b" ".join(b"w%d" % i for i in range(250_000))
    assert t.ids(text) == t.ids(text) and len(made) == 250_000


def test_words_with_one_sign_or_digit():
    t = packing.Tokens(packing.model_path("word_bpe_49k.json"))
    for text in ("Then, the. end! A1 b' c\" d| it's l'x X< na\u00efve, \u00e9. caf\u00e9s; ab\x7f ab\u0000", *(f"Word{chr(c)} x{chr(c)}" for c in range(33, 127))):
        assert np.frombuffer(t.ids(text.encode()), "<u4").tolist() == t.whole.encode(text, add_special_tokens=False).ids


def test_tokens_match_the_library():
    from tokenizers import Tokenizer

    path = packing.model_path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), packing.Tokens(path)
    rng, signs = random.Random(2), [*"aB's'tll REveé ÉßİΣﬁ①Ｂ9½\t\n한▁_-.!?'ñ́\xa0\x1c \x00", "<|endoftext|>", "'LL"]
    for _ in range(600):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(mine.ids(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing_is_whole_gapless_and_near_the_bound(spark, rows):
    from tokenizers import Tokenizer

    path = packing.model_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = packing.tokenise_and_pack(frame(spark, rows), path, 512).collect()
    sequences = collections.defaultdict(list)
    for r in got:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["start"] == 512 * r["piece"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512
    assert len(sequences) <= 1.05 * math.ceil(sum(map(len, want.values())) / 512) + 2
    assert packing.tokenise_and_pack(empty(spark), path).count() == 0


def fewest(pieces_, capacity):
    """The least number of sequences, by trying every way."""
    best = len(pieces_)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(pieces_):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= pieces_[k] and rooms[i] not in rooms[:i]:
                put(k + 1, [*rooms[:i], rooms[i] - pieces_[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - pieces_[k]])

    put(0, [])
    return best


def test_plan_is_near_the_exact_optimum():
    rng = random.Random(9)
    over = 0
    for _ in range(60):
        parts = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 11))), reverse=True)
        histogram = dict(collections.Counter(parts))
        want, bound = fewest(parts, 20), packing.least_sequences(histogram, 20)
        got = packing.plan(histogram, 20)
        n = sum(times for _, times in got)
        assert bound <= want <= n <= want + 1
        over += n - want
    assert over <= 3


def test_knapsack_is_exact():
    rng = random.Random(10)
    for _ in range(40):
        lengths = np.array(sorted(rng.sample(range(1, 15), 4)))
        copies, prices = np.array([rng.randint(0, 3) for _ in lengths]), np.array([rng.random() for _ in lengths])
        ways = [np.array(w) for w in itertools.product(*(range(c + 1) for c in copies)) if np.dot(w, lengths) <= 18]
        got = packing.knapsack(lengths, copies, prices, 18)
        assert got @ lengths <= 18 and (got <= copies).all() and got @ prices == pytest.approx(max(w @ prices for w in ways))


def test_plan_holds_the_histogram():
    rng = random.Random(7)
    histogram = {rng.randint(1, 4096): rng.randint(1, 400) for _ in range(300)}
    total, program = collections.Counter(), []
    n = 0
    for config, times in packing.plan(histogram, from_program=program):
        assert sum(a * b for a, b in config.items()) <= 4096
        n += times
        for a, b in config.items():
            total[a] += b * times
    assert dict(total) == histogram and n <= 1.04 * packing.least_sequences(histogram) and program[0] >= 0.9 * n
    assert packing.plan({}) == []
