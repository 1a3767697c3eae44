"""Each stage of the corpus pipeline on rows with null ids, ids on several texts, repeats, nulls and clashing columns."""

import glob
import re

import corpus_pipeline as pipe
import public_tokenizers
import pytest

from valuescope.llm import bpe, mixing, pieces

A, B, C = ("first text of the table " * 3, "a second one of other words", "third and last")
NEAR = " ".join(f"w{k}" for k in range(60))
#: doc_id, text, row: ids 5 and 8 stand on two texts, rows 0 and 1 are repeats.
ROWS = [(3, A, 0), (3, A, 1), (5, A, 2), (5, B, 3), (None, C, 4), (None, "only here", 5), (None, A, 6), (None, None, 7), (7, "", 8), (8, C, 9), (8, NEAR, 10),
        (9, NEAR + " x", 11), (None, NEAR, 12), (None, "only here", 13), (10, NEAR + " y", 14), (10, "\t", 15)]
SCHEMA = "doc_id long, text string, row int, lang string, source string, key string, kept string, component_id long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", f"src{r[2] % 3}", "k", "no", 1) for r in ROWS], SCHEMA)


def rows_of(df):
    assert df.columns == ["doc_id", "text", "row", "lang", "source", "key", "kept", "component_id"]
    return sorted(r["row"] for r in df.collect())


def test_exact_stage_decides_per_row(spark, docs):
    norm = {r[2]: " ".join((r[1] or "").replace("\t", " ").split(" ")) for r in ROWS}
    want = []
    for i, _, k in ROWS:
        ids = [j for j, _, n in ROWS if norm[n] == norm[k] and j is not None]
        if (i is None and not ids) or (ids and i == min(ids)):
            want.append(k)
    assert rows_of(pipe.stage_exact_dedup(spark, docs, "")) == want == [0, 1, 3, 5, 8, 9, 10, 11, 13, 14, 15]


def test_near_stage_decides_per_row(spark, docs):
    # by word sets: 3 and 5 on A, 8 on C, NEAR with its two variants; rows without id or words link with nothing
    assert rows_of(pipe.stage_near_dedup(spark, docs, "")) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15]


def test_near_stage_keeps_one_text_of_an_id(spark, docs):
    two = docs.where("row in (10, 11)").selectExpr("5L as doc_id", *docs.columns[1:])
    assert len(rows_of(pipe.stage_near_dedup(spark, two, ""))) == 1


def test_mixing_stage_decides_per_row(spark, docs):
    many = docs.crossJoin(spark.range(40).toDF("n")).selectExpr(
        "if(doc_id is null, null, doc_id + 100 * (n div 2)) as doc_id", "concat(text, ' more words', repeat(' z', n)) as text", "row * 100 + n as row", *docs.columns[3:])
    some = many.select("row", "doc_id", "text", "source", "lang").collect()
    keep = {(r["doc_id"], r["key"]) for r in mixing.mix(many, keyed=True).where("sampled").collect()}
    keys = {r["row"]: (r["doc_id"], r["key"]) for r in many.select("row", "doc_id", pipe.row_key(many, *mixing.KEY).alias("key")).collect()}
    got = rows_of(pipe.stage_mixing(spark, many, ""))
    assert got == sorted(k for k, v in keys.items() if v in keep)
    assert {r["row"] for r in some if r["doc_id"] is None} & set(got) and 0 < len(got) < len(some)
    assert len(got) == mixing.mix(many).where("sampled").count()


def test_stages_on_an_empty_table(spark, docs):
    for stage in (pipe.stage_exact_dedup, pipe.stage_near_dedup, pipe.stage_mixing):
        assert rows_of(stage(spark, docs.limit(0), "")) == []


def plain(rows):
    """Rows kept by toxicity, exact and near duplicates in plain Python; a row is (doc_id, text, row)."""
    one = [r for r in rows if "idiot" not in (r[1] or "")]
    norm = {r[2]: re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in one}
    two = []
    for r in one:
        ids = [x[0] for x in one if norm[x[2]] == norm[r[2]] and x[0] is not None]
        if r[0] == min(ids) if ids else r[0] is None:
            two.append(r)
    words = {r[2]: (r[1] or "").lower().split() for r in two}
    sets = {k: frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset() for k, w in words.items()}
    with_id = [r for r in two if r[0] is not None and sets[r[2]]]
    group = {r[2]: r[2] for r in with_id}
    for a in with_id:
        for b in with_id:
            x, y = sets[a[2]], sets[b[2]]
            if 100 * len(x & y) >= 75 * len(x | y):
                old, new = group[b[2]], group[a[2]]
                group = {k: new if g == old else g for k, g in group.items()}
    three = [r for r in two if r[2] not in group or r[0] == min(x[0] for x in with_id if group[x[2]] == group[r[2]])]
    return [sorted(r[2] for r in kept) for kept in (one, two, three)]


def test_run_against_plain_python(spark, tmp_path):
    rows = list(ROWS)
    for i in range(100, 180):
        bad = i % 8 == 0
        w = [f"t{i}w{k}" for k in range(30)]
        rows.append((i, " ".join(w) + (" idiot" if bad else ""), i))
        if not bad and i % 3 == 0:
            rows.append((1000 + i, " ".join(w) + " more", 1000 + i))
    labels = [(i, 1, int(i % 8 == 0)) for i in range(100, 180)]
    docs = spark.createDataFrame([(*r, "en", f"src{r[2] % 3}", "k", "no", 1) for r in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = pipe.ensure_checkpoint_dir(spark)
    before = set(glob.glob(f"{at}/pipeline-*"))
    out = pipe.run(spark, str(tmp_path)).collect()
    root = (set(glob.glob(f"{at}/pipeline-*")) - before).pop()
    step = [spark.read.parquet(f"{root}/{k}-{name}") for k, (name, _) in enumerate(pipe.STAGES)]
    assert [rows_of(d) for d in step[:3]] == plain(rows)
    assert any(r["doc_id"] is None for r in out)
    drawn = {(r["doc_id"], r["key"]) for r in mixing.mix(step[2], keyed=True).where("sampled").collect()}
    every = step[2].select("row", "doc_id", pipe.row_key(step[2], *mixing.KEY).alias("key")).collect()
    assert rows_of(step[3]) == sorted(r["row"] for r in every if (r["doc_id"], r["key"]) in drawn)
    m = bpe.model(public_tokenizers.path(pipe.PIECES))
    text = sorted((str(r["doc_id"]), r["text"] or "") for r in step[3].collect())
    assert sorted((str(r["doc_id"]), pieces.decode(m, r["ids"]) if r["ids"] else "") for r in out) == text and all(r["lossless"] for r in out)


def test_run_on_empty_tables(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipe.run(spark, str(tmp_path)).count() == 0
