import random

import pytest

import corpus_pipeline
from lexmill.llm import mixing, sharding

from .helpers import docs, edited, prose, rows
from .test_decontaminate import best_overlap
from .test_langid import SYLLABLES
from .test_mixing import brute as mixed
from .test_near_dedup import brute as near
from .test_near_dedup import tokens
from .test_sharding import brute as packed

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def language_words(lang, n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def corpus(seed=3):
    r = random.Random(seed)
    vocab = {lang: language_words(lang, 800, k) for k, lang in enumerate(SYLLABLES)}
    bench = [(i, prose(r, vocab[r.choice(sorted(vocab))], 25)) for i in range(6)]
    table = []

    def add(text, lang):
        table.append((len(table), text, lang, f"src{r.randrange(4)}", None if text is None else len(text)))

    for i in range(90):
        lang = r.choice(sorted(vocab))
        base = prose(r, vocab[lang], r.randint(30, 90))
        add(base, lang)
        if i % 6 == 0:
            add(base, lang)
            add(edited(r, base, vocab[lang], 3), lang)
        if i % 15 == 1:
            item = r.choice(bench)[1].split()
            item[9] = "other"
            add(prose(r, vocab[lang], 30) + " " + " ".join(item) + " " + prose(r, vocab[lang], 30), lang)
    for junk in ("", None, "12345 67 89 !!", "--- ... 0000"):
        add(junk, "aa")
    return table, bench


def write(spark, path, table, bench):
    docs(spark, table).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "benchmark_overlap", "mixture", "shards"]


def test_run_against_brute_force(spark, tmp_path):
    table, bench = corpus()
    got = corpus_pipeline.run(spark, write(spark, tmp_path, table, bench))
    assert got.columns == [*NAMES, "shard"]
    # By another way: junk has no letters; all else is of one of the languages.
    left = [t for t in table if t[1] and any(c.isalpha() for c in t[1])]
    gone = {i for i, _ in near([(t[0], t[1]) for t in left])[0]}
    left = [t for t in left if t[0] not in gone]
    clean = [t for t in left if not any(best_overlap(tokens(u), tokens(t[1])) for _, u in bench)]
    assert len(gone) >= 25 and len(left) - len(clean) >= 4
    copies = [t[:5] for t in mixed(clean, mixing.WEIGHTS)]
    sizes = {}
    for t in copies:
        sizes[f"={t[0]}"] = sizes.get(f"={t[0]}", 0) + len(t[1].encode())
    shard = packed([(n, k) for k, n in sizes.items()], sharding.CAPACITY)
    assert rows(got) == sorted(((*t, shard[f"={t[0]}"]) for t in copies), key=repr)


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path, stage):
    path = write(spark, tmp_path, [], [])
    _, f = corpus_pipeline.STAGES[stage]
    got = f(spark, docs(spark, []), path)
    assert got.columns == NAMES + ["shard"] * (stage == 4) and got.count() == 0


def test_odd_rows(spark, tmp_path):
    table, bench = corpus(4)
    odd = [(None, "kato mire suno kami toka remi noka tosu", "aa", "src1", 1), (7000, "kato mire suno " * 20_000, "aa", None, None), (7001, "tosu kami noka remi " * 3, None, "src1", None), (7001, "tosu kami noka remi " * 3, None, "src1", None)]
    bench += [(None, "x " * 20), (99, None), (98, "")]
    got = corpus_pipeline.run(spark, write(spark, tmp_path, table + odd, bench)).collect()
    ids = [r["doc_id"] for r in got]
    assert all(r["shard"] is not None for r in got)
    # The sources of the odd rows have rates of their own, so that each may be repeated or left out, but alike in every run.
    assert sorted(map(repr, got)) == sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    judged = {r["doc_id"] for r in corpus_pipeline.language(spark, docs(spark, table + odd), str(tmp_path)).collect()}
    assert {None, 7000, 7001} <= judged and set(ids) <= judged
    texts = {(r["doc_id"], r["text"]) for r in got}
    assert texts <= {(t[0], t[1]) for t in table + odd}
    left = {r[0] for r in rows(corpus_pipeline.near_duplicates(spark, docs(spark, odd), str(tmp_path)), "doc_id")}
    assert left == {None, 7000, 7001}


def test_extra_columns_stay(spark, tmp_path):
    table, bench = corpus(5)
    path = write(spark, tmp_path, table, bench)
    df = docs(spark, table).selectExpr("*", "1 as language", "2 as accepted", "3 as lead", "4 as id", "5 as rate", "6 as copy", "7 as item_id", "8 as kept_doc_id")
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, df, path)
        df = spark.createDataFrame(got.collect(), got.schema)
        assert df.columns[5 : 13 if name == "shards" else None] == ["language", "accepted", "lead", "id", "rate", "copy", "item_id", "kept_doc_id"]
    assert df.count() > 50 and df.columns[13:] == ["shard"]


def test_of_several_rows_of_an_id_a_text_stays(spark, tmp_path):
    odd = [(1, None), (1, "some words that stay"), (2, None), (2, None), (None, None), (None, None)]
    got = corpus_pipeline.near_duplicates(spark, docs(spark, odd), str(tmp_path))
    assert rows(got, "doc_id", "text") == sorted([(1, "some words that stay"), (2, None), (None, None), (None, None)], key=repr)


def test_ids_are_integers(spark, tmp_path):
    path = write(spark, tmp_path, [], [])
    df = docs(spark, [(1, "some words")]).selectExpr("'https://a.b/c' AS doc_id", "text", "lang", "source", "n_chars")
    for stage in (1, 2):
        with pytest.raises(ValueError, match="ids are integers"):
            corpus_pipeline.STAGES[stage][1](spark, df, path)
