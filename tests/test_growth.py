"""Steps whose work must grow with the input: the same rows as the plain form, without its copies."""

import re

from pyspark.sql import functions as F

from claimloom.plans import graph as G


def test_evidence_of_derived_claims_is_counted_without_lists(spark):
    lists = {s: sorted({(s * 7 + i * i) % 23 for i in range(s % 6)} | ({99} if s % 2 else set())) for s in range(12)}
    direct = spark.createDataFrame([(s, s % 3, "blocked" if s % 5 == 0 else "eligible", e + e[:1]) for s, e in lists.items()], "claim long, module int, status string, evidence array<long>")
    support = [(c, "inference" if c % 2 else "hypothesis", [(c * k + k) % 14 for k in range(c % 7)], c % 3 > 0) for c in range(30)] + [(30, "inference", None, True), (31, "inference", list(range(12)), True)]
    derived = spark.createDataFrame([(c, k, s and list(dict.fromkeys(s)), p) for c, k, s, p in support], "claim long, kind string, support array<long>, has_plan boolean")
    want = {tuple(r) for r in G.derived_ledger(derived, direct).withColumn("evidence", F.size("evidence").cast("long")).withColumn("gaps", F.array_join("gaps", ",")).collect()}
    got = {tuple(r) for r in G.derived_ledger(derived, direct, counted=True).withColumn("gaps", F.array_join("gaps", ",")).collect()}
    assert got == want and max(r[4] for r in got) > 10
    named, have = derived.select("claim", "support"), direct.select(F.col("claim").alias("s"), "evidence")
    plain = {tuple(r) for r in G.shared_evidence(have, named).collect()}
    assert plain and all({tuple(r) for r in G.shared_evidence(have, named, wide=w).collect()} == plain for w in (1, 3))


def test_text_search_shuffles_no_pair_of_query_and_document(spark, monkeypatch):
    from claimloom.operators import retrieval as R
    from claimloom.operators.postings import Index
    from claimloom.sources.scratch import scratch_path

    monkeypatch.setattr(R, "CELLS", 600)  # tiles of some documents
    texts = [(f"d{i}", " ".join(f"w{(i * j + j * j) % 17}" for j in range(i % 9)) + (" é,Wörter" if i % 4 == 0 else "")) for i in range(80)] + [(f"x{i}", "w1 w2 wörter") for i in range(30)] + [("n", None), ("e", "")]
    docs = spark.createDataFrame(texts, "doc string, text string").repartition(5)
    asked = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 19}" for j in range(i % 6)) + " WÖRTER" * (i % 2)) for i in range(25)] + [(99, None), (98, "none")], "q long, text string")
    once = R.text_search(docs, asked, k=7, doc_id="doc", query_id="q")
    index = Index(spark, scratch_path(spark, "index"), doc_type="string").add(docs, doc_id="doc").search(asked, k=7, query_id="q")
    want = {tuple(r) for r in index.select("q", "doc", "score", "place").collect()}
    assert {tuple(r) for r in once.select("q", "doc", "score", "place").collect()} == want and len(want) > 100
    blocks = R.text_search(docs, asked, k=7, doc_id="doc", query_id="q", most=6)
    assert {tuple(r) for r in blocks.select("q", "doc", "score", "place").collect()} == want
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_normalised_text_is_worked_out_once_for_all_markers(spark):
    from claimloom.functions.text import SPACE, normalize_text
    from claimloom.operators import evidence as E

    spaces = [" ", "\t", "\n", "\x0b", "\f", "\r", *(chr(i) for i in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))]
    texts = [a + "Ab" + a + b + "c" + b + a + b for a in spaces for b in spaces] + ["", None, "Ä“x”—y", " ", "\x85 z", "\U0001f600 　"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.trim(F.regexp_replace(F.lower("t"), SPACE + "+", " "))
    assert df.where(~normalize_text(F.col("t")).eqNullSafe(plain)).count() == 0
    plan = df.select(E.must_quote(F.col("t")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(t") <= 3  # once in each branch and in the choice of it
    assert df.select(F.lit("Top 10, #1 of 3% SALES").alias("t")).select(E.must_quote(F.col("t"))).first()[0] == ["10", "1", "3%", "top 10", "#1 ", "sales"]


def test_runs_of_words_and_characters(spark):
    from claimloom.operators.containment import runs_of

    texts = {1: "a b c d e", 2: "b c d x é日本 b c d", 3: "", 4: "日本 b", 5: None, 6: "c d"}
    hays = spark.createDataFrame(list(texts.items()), "d long, hay string").coalesce(1)
    for how in ({"words": 3}, {"words": 1}, {"chars": [2]}, {"chars": [1, 3]}):
        split = lambda x: [x[i : i + n] for n in how.get("chars", []) for i in range(len(x) - n + 1)] if "chars" in how else [" ".join(x.split(" ")[i : i + how["words"]]) for i in range(len(x.split(" ")) - how["words"] + 1)]  # noqa: B023, E731
        want = {(d, r) for d, x in texts.items() if x for r in split(x)}
        got = runs_of(hays, **how).collect()
        assert len(got) == len(set(got)) == len(want)
        runs = {r for _, r in want}
        assert len({r.run for r in got}) == len(runs)
        some = runs_of(spark.createDataFrame([(9, "b c d" if "words" in how and how["words"] == 3 else "b")], "d long, hay string"), **(how if "words" in how else {"chars": [1]})).select("run")
        kept = {tuple(r) for r in got} & {(d, r) for d in texts for r in {x[0] for x in some.collect()}}
        assert {tuple(r) for r in runs_of(hays, wanted=some, **how).collect()} == kept == {tuple(r) for r in runs_of(hays, wanted=some, most=0, **how).collect()}


def test_pages_are_read_once_to_select_them(spark, sf):
    from claimloom.queries import pages

    plan = pages.fitted(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 1


def test_only_the_tables_asked_for_are_made(spark, sf, monkeypatch):
    from claimloom.operators import databases as D
    from claimloom.queries import databases

    made, cut = [], D.cut
    monkeypatch.setattr(D, "cut", lambda df, name="cut": made.append(name) or cut(df, name))
    load = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    assert list(databases.databases(load, ["website_topics"])) == ["website_topics"]
    assert sorted(made) == ["refs", "refs", "websites"]


def test_constraints_group_no_keys_where_rows_are_read(spark, monkeypatch):
    from claimloom.sources import tables as S

    monkeypatch.setattr(S, "PART_ROWS", 40, raising=False)
    rows = [(i % 90 if i % 11 else None, i % 7 or None, i % 5 or None) for i in range(300)] + [(1, 1, 1)] * 200 + [(7, i, i) for i in range(150)]
    parents = [(k,) for k in range(0, 95, 2)] * 3 + [(None,)] * 50
    df, theirs = spark.createDataFrame(rows, "k long, line int, p int"), spark.createDataFrame(parents, "id long")
    got = S.check_constraints(df, key=["k", "line"], required=["p"], checks={"p": F.col("p") < 4}, parent=(theirs, "k", "id"))
    want = [(k, n, "not_null:p") for k, n, p in rows if p is None] + [(k, n, "check:p") for k, n, p in rows if p is not None and p >= 4]
    want += [(*key, "primary_key") for key in {r[:2] for r in rows} if sum(r[:2] == key for r in rows) > 1]
    want += [(k, n, "foreign_key:k") for k, n, p in rows if k is not None and (k,) not in parents]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # rows are dealt as they are, to tasks that follow their number; before, to 4 after a map of all keys of a file's part
    assert re.search(rf"hashpartitioning\(k#\d+L, line#\d+, {-(-len(rows) // 40)}\), REPARTITION_BY_NUM", plan)


def _quotes_and_texts():
    words = [w + str(i % 7) for i, w in enumerate("größe alpha 数据市场 beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi".split() * 3)]
    texts = [(i, " ".join(words[i % 11 : i % 11 + 12 + i % 5]) + " end" * (i % 4)) for i in range(60)]
    texts += [(100 + i, "same copy of a text that\tholds  many common words and more of them") for i in range(40)]
    texts += [(200, ""), (201, None), (202, "x" * 1_200_000 + " the last quote lies far behind a very long word here"), (203, "数据"), (204, "The Last Quote Lies far behind a very long word")]
    quotes = [(i, " ".join(words[i : i + n])[i % 3 :]) for i in range(14) for n in (2, 5, 8, 11)]
    quotes += [(50, "copy of a text that holds many comm"), (51, "copy of a text that holds many comm"), (52, "quote lies far behind a very long word"), (53, "数据市场"), (54, "num"), (55, ""), (56, None), (57, "beta4"), (57, "eta3"), (58, "no such quote is in any of the texts")]
    return quotes, texts


def test_few_quotes_are_found_as_many_are(spark, monkeypatch):
    from claimloom.operators import containment
    from claimloom.operators import evidence as E

    quotes, texts = _quotes_and_texts()
    plain = lambda x: " ".join((x or "").lower().split())
    want = sorted({(q, d) for q, a in quotes for d, b in texts if len(plain(a)) >= 4 and plain(a) in plain(b)})
    q, d = spark.createDataFrame(quotes, "q int, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    found = lambda: sorted(map(tuple, E.match_quotes(q, d, quote_id="q", doc_id="doc_id").collect()))
    few = found()
    monkeypatch.setattr(containment, "FEW", -1)
    assert few == found() == want and len({x for x, _ in want}) > 15 and (51, 139) in want and (52, 202) in want


def test_texts_are_read_once_for_few_quotes(spark):
    from claimloom.operators import evidence as E
    from claimloom.operators.containment import containing

    quotes, texts = _quotes_and_texts()
    q = spark.createDataFrame(quotes, "q int, text string").where("length(text) > 0")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    d = spark.createDataFrame(texts, "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    assert E.match_quotes(q, d, quote_id="q", doc_id="doc_id").count() > 100 and read.value == len(texts)
    assert containing(q.selectExpr("q", "text as needle"), d.selectExpr("doc_id as d", "text as hay")).count() > 100 and read.value == 2 * len(texts)
