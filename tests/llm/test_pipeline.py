"""The pipeline's stages against brute force on a small corpus."""

import random
import re
import zlib
from array import array

import pytest
from tokenizers import Tokenizer

from lumenfold.llm import packing, tokens

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = {"en": "the of and that with from this have which their would there could other about people".split(),
         "de": "der die und nicht eine auch sich werden schon durch zwischen während große über immer".split()}


def corpus():
    rnd, out = random.Random(1), []
    for i in range(160):
        lang = rnd.choice(list(WORDS))
        out.append((i, " ".join(rnd.choice(WORDS[lang]) + str(rnd.randrange(3)) * (rnd.random() < 0.2) for _ in range(90)), lang))
    rows = [(d, t + (' token = "0123456789abcdef0123456789abcdef0123"' if d % 10 == 0 else ""), lang, "s", len(t)) for d, t, lang in out]
    rows += [(500 + d, t.replace(" ", "\n", 1) + " tail", lang, "s", 1) for d, t, lang, *_ in rows[:30]]  # near copies
    rows += [(700 + d, t, lang, "s", 1) for d, t, lang, *_ in rows[:5]]  # copies
    noise = [(900 + i, " ".join("".join(rnd.choice("qxzjkvwy") for _ in range(7)) for _ in range(80)), None, "s", 1) for i in range(4)]
    junk = [(2000 + i, " ".join(w + "$$$" for w in t.split()), lang, "s", 1) for i, t, lang, *_ in rows[40:60]]
    odd = [(990, None, None, "s", None), (991, "", "en", "s", 0), (992, "short text", "en", "s", 10), (993, "the " * 3000, "en", "s", 1)]
    return rows + noise + junk + odd


DDL = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns
        seen.append({r.doc_id: r for r in kept.collect()})
    lang, quality, unique, clean = seen
    assert set(lang) == {r[0] for r in rows} - {900, 901, 902, 903}
    assert set(quality) == {r[0] for r in rows if r[0] < 900}
    assert set(unique) == set(range(160))
    assert set(clean) == set(unique)
    for d, r in clean.items():
        assert r.text == re.sub(r'token = "[0-9a-f]+', "[secret]", unique[d].text) and r.n_chars == len(r.text)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(tokens.public_path("word_bpe_49k.json"))
    for d, r in clean.items():
        ids = array("I", [*tok.encode(r.text, add_special_tokens=False).ids, packing.END_ID])
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    assert {p.doc_id for p in pieces} == set(clean)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_secret_scan_keeps_columns_of_any_name(spark, tmp_path):
    rows = [(1, 'password = "abcdefgh1234"', 0, "x", ["y"]), (2, None, 0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, base string, candidates array<string>")
    found = {r.doc_id: r for r in corpus_pipeline.secret_scan(spark, docs, str(tmp_path)).collect()}
    assert (found[1].base, found[1].candidates, found[1].n_chars) == ("x", ["y"], len(found[1].text)) and "abcdefgh" not in found[1].text
    assert found[2].text is None and found[2].base is None


def test_odd_columns_long_texts_and_repeats_pass_all_stages(spark, tmp_path):
    """Columns named like the operators' own, with dots, of types without a hash; repeated rows; a very long text."""
    rnd = random.Random(2)
    prose = lambda n: " ".join(rnd.choice(WORDS["en"]) + str(rnd.randrange(90)) * (rnd.random() < 0.3) for _ in range(n)).capitalize() + "."
    texts = [prose(90) for _ in range(40)] + [prose(60_000)]
    rows = [(i, t, "en", "s", len(t), {"a": i}, "x", "y", [{"k": 1}]) for i, t in enumerate(texts)]
    rows += rows[:3] * 4  # whole rows again
    rows += [(3, texts[3], "en", "s", 1, {"b": j}, "x", None, None) for j in range(3)]  # an id and a text again, other columns
    rows += [(None, None, None, None, None, None, None, None, None), (None, texts[5], None, None, None, None, None, None, None)]
    ddl = DDL + ", m map<string,bigint>, langid_pred string, `a.b` string, `k\"` array<map<string,int>>"
    docs = spark.createDataFrame(rows, ddl).repartition(3)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(41))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == set(range(41))
