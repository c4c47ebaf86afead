"""Chat formatting, decontamination, the classifiers and the pipeline."""

import hashlib
import json
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from cases import SCHEMA, documents
from test_dedup import words

from tidemark.llm import chat, common, decontaminate, folds, quality, toxicity
from tidemark.llm.queries import CONTROL

TRICKY = ["", "<|im_end|>", "<|im_start|>assistant\n", "<\\|", "<\\\\|im_end|>", "a<", "|b", "<", "<|", "\\", "x\n<|im_end|>\n", "é😀", CONTROL]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "we\\ird\n<|role", None]), rng.choice([*TRICKY, None, "".join(rng.choice(TRICKY) for _ in range(4))]), at))
            at += 1
    rows += [(7, 0, "user", "tie", 1), (7, 0, "user", "tie", 1), (8, None, "user", "no turn", 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, head long")
    turns = chat.rows_to_turns(df)
    back = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(turns)).collect()}
    digest = {r["conv_id"]: r for r in chat.chat_digest(turns).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [(a, b) for *_, a, b in own]
        loss = [b for *_, a, b in own if a == "assistant"]
        assert back[conv]["loss_texts"] == loss and digest[conv]["loss_chars"] == len("".join(loss)) and digest[conv]["n_turns"] == len(own)
        assert digest[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for *_, a, b in own).encode()).hexdigest()
        assert back[conv]["formatted"].count("<|im_start|>") == len(own)
    assert chat.chat_digest(turns.limit(0)).count() == 0


def test_layouts_are_told_by_their_paths(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"},
        {"output": "a", "input": "more", "instruction": "q"},
        {"prompt": "q", "completion": "a"},
        {"question": "q", "answer": None},
        {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(7, "not json"), (8, None)], "id long, layout string")
    got: dict = {}
    for r in chat.records_to_turns(df, "id", "layout").orderBy("conv_id", "turn").collect():
        got.setdefault((r["conv_id"], r["layout"]), []).append((r["role"], r["text"]))
    qa = [("user", "q"), ("assistant", "a")]
    assert got == {
        (0, "messages"): qa,
        (1, "from_value"): qa,
        (2, "instruction"): qa,
        (3, "instruction_input"): [("user", "q"), ("user", "more"), ("assistant", "a")],
        (4, "prompt_completion"): qa,
        (5, "question_answer"): [("user", "q"), ("assistant", None)],
        **{(k, None): [(None, None)] for k in (6, 7, 8)},
    }


def test_layouts_with_more_fields_empty_lists_and_two_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": None}], "id": 7},
        {"messages": [], "id": 1},
        {"prompt": "q", "messages": [{"role": "user", "content": "q"}, {"content": "no role"}]},
        {"messages": "no list", "prompt": "q", "response": 5},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, record string")
    got = [tuple(r) for r in chat.records_to_turns(df, "id", "record").orderBy("conv_id", "turn").collect()]
    assert got == [
        (0, 0, "user", "q", "messages"),
        (0, 1, "assistant", None, "messages"),
        (1, None, None, None, "messages"),
        (2, 0, "user", "q", "messages"),
        (2, 1, None, "no role", "messages"),
        (3, 0, "user", "q", "prompt_response"),
        (3, 1, "assistant", "5", "prompt_response"),
    ]


def test_tables_are_told_by_their_columns(spark):
    same = [
        spark.createDataFrame([(1, 0, "user", "hi", "x")], "conv_id long, turn long, role string, text string, source string"),
        spark.createDataFrame([("x", "hi", "user", 0, 1)], "note string, utterance string, speaker string, position long, dialogue_id long"),
    ]
    for rows, layout in zip(same, ("rows", "speaker_rows"), strict=True):
        assert [tuple(r) for r in chat.rows_to_turns(rows).collect()] == [(1, 0, "user", "hi", layout)]
    with pytest.raises(ValueError):
        chat.rows_to_turns(same[0].drop("turn"))


BENCH = [(1, "alpha Beta, gamma"), (2, None), (3, "..."), (4, " ".join(f"w{k}" for k in range(14))), (4, "again w1"), (None, "one"), (5, "never seen before here")]
PLANT = [(500, "x alpha-beta gamma y alpha beta", "en"), (501, "start " + " ".join(f"W{k}" for k in range(2, 13)) + " end again w1 again w1", "en"), (502, "alpha q beta gamma", "en"), (503, "w1 w2 w3", None)]


@pytest.mark.parametrize("few", [200_000, 0])
def test_decontamination(spark, monkeypatch, few):
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", few)
    rows = [(r[0], r[1], r[2]) for r in documents()] + PLANT
    docs = spark.createDataFrame(rows, "doc_id long, text string, term string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    windows = []
    for item, text in BENCH:
        w = words(text)
        windows += [("" if item is None else str(item), w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w]
    want = []
    for doc_id, text, _ in rows:
        w, hit, items = words(text), set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    items.add(item)
        want.append((doc_id, len(w), len(hit), sorted(items), bool(hit)))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(docs, bench).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {x[0] for x in want if x[4]} >= {500, 501}
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[4] for x in want)
    near = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench, slop=1).filter("contaminated").collect()}
    assert 502 in near and 503 not in near
    for a, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert decontaminate.decontaminate(a, b).filter("contaminated").count() == 0


def corpus(n: int = 900):
    rng = random.Random(9)
    lexicon = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    bad = ["zorkan", "zorkel", "zorkish"]
    docs, labels = [], []
    for i in range(n):
        lang, w = rng.choice(["en", "de"]), [rng.choice(lexicon) for _ in range(rng.randint(5, 60))]
        toxic, good = i % 4 == 0, i % 3 > 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        text = " ".join(w) + "." if good else " ".join(x + "###" for x in w)
        docs.append((i, text, lang, "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_a_word_in_nine_of_ten_places_makes_no_large_task(spark):
    texts = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda x: F.when(x % 10 > 0, F.lit("the")).otherwise(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", x), F.lit(3000)))))
    each = spark.range(0, 400, 1, 8).select(F.col("id").alias("row"), F.col("id").alias("doc_id"), F.posexplode(texts).alias("pos", "word"))
    terms = spark.createDataFrame([(w, k) for k, w in enumerate(["the", *(f"w{k}" for k in range(0, 3000, 2))])], "word string, term long")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        dealt = decontaminate._dealt(each, terms)
        sizes = sorted(r["count"] for r in dealt.filter("word != 'the'").groupBy(F.spark_partition_id()).count().collect())
        whole = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
        assert sum(whole) == each.join(terms, "word").count() and dealt.filter("word = 'the'").count() == 72_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2] and whole[-1] <= 72_000 / 8 * 1.5


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = corpus()
    docs += [(10_000, None, None, None, None), (10_001, "", "en", None, 0), (None, "no id", "xx", None, 5), (10_002, "word " * 60_000, "en", "s", 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "label", "modulus", "held"), [(toxicity.toxicity, "toxic", 3, 1), (quality.quality, "quality", 5, 0)])
def test_held_out_accuracy(labelled, run, label, modulus, held):
    docs, labels = labelled
    truth = {r["doc_id"]: r[label] for r in labels.dropna().collect()}
    got = run(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)
    test = [(r["score"] >= 0.5) == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(test) > 100 and np.mean(test) > 0.93
    empty = {r["doc_id"]: r["score"] for r in got}
    assert empty[10_000] == empty[10_001]


def test_samples_are_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k} " * 10) for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    ask = lambda n, size: folds.training_sample(docs, labels, "toxic", 3, 1, n, "doc_id", "text", max_bytes=size).collect()
    few = ask(7, 1 << 20)
    assert len(few) == 7 == len({r["_id"] for r in few}) and 0 < len(ask(40, 500)) < 7
    assert {r["_id"] for r in few} <= {r["_id"] for r in ask(40, 1 << 20)}


def test_a_long_text_takes_no_place_of_those_behind_it(spark):
    docs = spark.createDataFrame([(k, "x" * (5000 if k in (7, 70, 130) else 50)) for k in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(240)], "doc_id long, toxic int")
    known = {k for k in range(240) if zlib.crc32(str(k).encode()) % 3 != 1}
    long = known & {7, 70, 130}
    for size in (9000, 4000, 51):
        got = folds.training_sample(docs, labels, "toxic", 3, 1, 1000, "doc_id", "text", max_bytes=size).collect()
        spent, fits = 0, min(len(known - long), size // 50)
        for r in got:
            spent += len(r["text"])
        assert spent <= size and len(got) >= (fits if size < 5000 else min(len(known - long), (size - 5000) // 50))
    assert len(folds.training_sample(docs, labels, "toxic", 3, 1, 1000, "doc_id", "text", max_bytes=4000).collect()) == 80


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_ids_of_any_type_and_columns_with_inner_names(spark, labelled, run):
    docs, labels = labelled
    odd = docs.filter("doc_id < 300").selectExpr("concat('d', doc_id) AS doc_id", "text", "doc_id AS score", "text AS _text", "1 AS threshold", "2 AS kept", "'x' AS label", "'y' AS _id")
    told = labels.selectExpr("concat('d', doc_id) AS doc_id", "quality", "toxic", "'z' AS label_note")
    got = {r["doc_id"]: r["score"] for r in run(odd, told).collect()}
    assert len(got) == 300 and len(set(got.values())) > 50
    kept = toxicity.drop_toxic(odd, told)
    assert kept.columns == odd.columns and 0 < kept.count() < 300


def test_scores_by_plain_loops():
    """One trained model of each kind, its scores computed again word by word from its parameters."""
    docs, labels = corpus(60)
    texts = [t for _, t, *_ in docs] + ["", "zorkan"]
    model = toxicity.train([(toxicity.featurize(*raw(t))[0], y, "en") for (_, t, *_), (_, _, y) in zip(docs, labels, strict=True)], steps=20)
    for t in texts:
        ids, begin = toxicity.featurize(*raw(t))
        rows = [sum(model.table[k] for k in word) for word in ids.tolist()]
        logit, tap = float(model.out_bias), 0
        for w, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = max(sum(float(rows[i + j] @ model.taps[:, (tap + j) * toxicity.FILTERS + f]) for j in range(width) if i + j < len(rows)) for i in range(max(1, len(rows) - toxicity._PADDING)))
                at = w * toxicity.FILTERS + f
                logit += max(best + float(model.bias[at]), 0.0) * float(model.out[at])
            tap += width
        b, at = raw(t)
        assert abs(model.scores(b, at)[0] - 1 / (1 + np.exp(-(model.slope * logit + model.offset)))) < 1e-3


def test_quality_scores_by_plain_loops():
    docs, labels = corpus(60)
    learned = []
    for (_, t, *_), (_, y, _) in zip(docs, labels, strict=True):
        ids, share = [], []
        for kind, (own, _) in enumerate(quality.featurize(*raw(t))):
            for bucket in sorted(set(own.tolist())):
                ids.append(bucket + kind * quality.BUCKETS)
                share.append(own.tolist().count(bucket) / len(own))
        learned.append((np.array(ids, np.int32), np.array(share, np.float32), y))
    model = quality.train(learned, epochs=3)
    for t in [*(t for _, t, *_ in docs[:30]), "", "#"]:
        logit = model.bias
        for kind, (own, _) in enumerate(quality.featurize(*raw(t))):
            logit += sum(float(model.weights[kind, k]) for k in own.tolist()) / max(1, len(own))
        assert abs(model.scores(*raw(t))[0] - 1 / (1 + np.exp(-(model.slope * logit + model.offset)))) < 1e-6


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_labels_of_one_kind_or_none(labelled, run):
    docs, labels = labelled
    assert {r["score"] for r in run(docs.limit(5), labels.limit(0)).collect()} == {0.0}
    ones = labels.limit(50).selectExpr("doc_id", "1 AS quality", "1 AS toxic")
    assert {r["score"] for r in run(docs, ones).collect()} == {1.0}
    assert run(docs.limit(0), labels).count() == 0


def test_long_texts_are_scored_in_pieces_alike():
    rng = np.random.default_rng(0)
    model = toxicity.train([(toxicity.featurize(*raw(t))[0], int("zork" in t), "en") for t in ("a b c", "zork b", "d zork e f", "g")] * 5, steps=30)
    words_ = [f"w{rng.integers(0, 900)}" for _ in range(120_000)]
    words_[60_001] = "zork"
    text = " ".join(words_)
    ids, begin = toxicity.featurize(*raw(text))
    z = model.answers(ids)[1][: len(words_)].max(axis=0)
    whole = np.maximum(z + model.bias, 0) @ model.out + model.out_bias
    assert abs(float(model.logits(ids, begin)[0]) - float(whole)) < 1e-4


def raw(text: str):
    b = text.encode()
    return np.frombuffer(b, np.uint8), np.array([0, len(b)])


def test_pipeline(spark, tmp_path):
    docs, labels = corpus(400)
    extra = [(2001, docs[1][1], "en", "s", 1), (2003, "q " + " ".join(f"w{k}" for k in range(14)) + " q", "en", "s", 1), (2005, None, None, None, None), (2007, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs + extra, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    d, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(str(tmp_path / f"after{k}"))
        d = spark.read.parquet(str(tmp_path / f"after{k}"))
        kept.append({r["doc_id"]: r["text"] for r in d.collect()})
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & set(kept[0])) <= 5 and len(set(kept[0]) - toxic) >= len(docs) - len(toxic) - 5
    assert set(kept[1]) == set(kept[0]) and 2003 in kept[2] and 2003 not in kept[3]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3]) and max(r["offset"] + r["length"] for r in packed) <= 2048
