import json
import math

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import scalars as S
from corpusmill.operators import extract, generate, metrics, mix, profile, prompts, render, responses, snippets, validate
from corpusmill.plans import catalogue
from corpusmill.sources import files, repository
from corpusmill.streaming import dedup

SAMPLE = "_ord long, type string, question string, answer string, demand string, scheme string, trace_text string, trace struct<steps: array<struct<action: string, evidence: string, conclusion: string>>, summary: string>, repository string, code_snippets array<struct<file_path: string, line_start: int, line_end: int, code: string>>"
SNIPPET = [("f.py", 1, 2, "x = 1234567")]


def sample(o, q="a question to ask", a="the question is answered here", kind="qa", t="t" * 30, trace=None, repo="r", cs=SNIPPET):
    qa = kind != "design"
    return (o, kind, q if qa else None, a if qa else None, None if qa else q, None if qa else a, t, trace, repo, cs)


def stages(spark, rows, strict=True):
    df = spark.createDataFrame(rows, SAMPLE)
    return {r["_ord"]: r["failed_stage"] and f"{r['failed_stage']}:{r['reason']}" for r in validate.judged(df, strict).collect()}


def test_lengths_are_inclusive(spark):
    rows = [sample(0, q="q" * 9), sample(1, q="q" * 10), sample(2, q="other things", a="a" * 19), sample(3, q="1234567890", a="a" * 20), sample(4, q="9876543210", t="t" * 29), sample(5, q="5555555555"), sample(6, repo=""), sample(7, kind="mcq"), sample(8, kind=None), sample(9, q=None)]
    got = stages(spark, rows)
    assert got == {0: "basic:question", 1: "logic:logic", 2: "basic:answer", 3: None, 4: "basic:trace", 5: None, 6: "basic:repository", 7: "basic:type", 8: "basic:type", 9: "basic:question"}


def test_structured_traces(spark):
    step = ("read", "f.py", "done")
    rows = [sample(k, q=f"question number {k}", a="a question is answered here", kind=kind, t=None, trace=(steps, s)) for k, (kind, steps, s) in enumerate([("qa", [step] * 2, "s" * 20), ("qa", [step], "s" * 20), ("design", [step] * 2, "s" * 20), ("design", [step] * 3, "s" * 19), ("qa", [("read", None, "x")] * 2, "s" * 20), ("qa", None, None)])]
    assert stages(spark, rows, strict=False) == {0: None, 1: "basic:steps", 2: "basic:steps", 3: "basic:summary", 4: "basic:step fields", 5: "basic:steps"}


def test_duplicates_are_ranked_before_later_checks(spark):
    q = "why is the sky blue"
    bad = [("f.py", 0, 0, "x")]
    rows = [sample(0, q=q, a="it is blue because of the sky", cs=bad), sample(1, q=q, a="it is blue because of the sky"), sample(2, q=q + " (variant 1)", a="it is blue because of the sky"), sample(3, q="Other things " + q, a="it is blue because of the sky")]
    assert stages(spark, rows) == {0: "code:code", 1: "duplicate:duplicate", 2: None, 3: None}
    rows = [sample(0, q=q + " (variant 1)", a="it is blue because of the sky"), sample(1, q=q, a="it is blue because of the sky")]
    assert stages(spark, rows) == {0: None, 1: "duplicate:duplicate"}


def test_snippets(spark):
    for cs, strict, lenient in [([], True, False), (None, True, False), ([("f", 0, 0, "x" * 10)], False, True), ([("f", 3, 2, "x" * 10)], False, False), ([("", 1, 2, "x" * 10)], False, False), ([("f", 1, 2, "\u00a0" + "x" * 9)], False, False)]:
        df = spark.createDataFrame([sample(0, cs=cs)], SAMPLE)
        assert df.select(validate.snippets_fit(True), validate.snippets_fit(False)).first()[:] == (strict, lenient)


def test_whole_texts(spark, tmp_path):
    """What stands behind a prefix is rewritten, offered and counted."""
    text = "x" * 250 + " def f def g 这段代码"
    spark.createDataFrame([(1, text, "en", "src0")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {n: catalogue.queries()[n](spark, str(tmp_path)).first() for n in ("name_regex", "mcq_options", "vague_rewrite")}
    assert got["name_regex"]["n_def"] == 3 and text in got["mcq_options"]["options"].split("/")
    out = got["vague_rewrite"]["out"]
    assert out.startswith("x" * 250 + " def f def g ") and "这段代码" not in out


def test_bleu_of_whole_texts(spark, tmp_path):
    """A change behind the 30th word counts, and the brevity is that of the whole texts."""
    words = [f"w{k}" for k in range(60)]
    texts = [(1, words, words), (2, words, [*words[:40], "other", *words[41:]]), (3, words, words[:45])]
    rows = [(k, turn, role, " ".join(t)) for k, q, a in texts for turn, (role, t) in enumerate([("user", q), ("assistant", a)])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r["bleu"] for r in catalogue.queries()["bleu_pairs"](spark, str(tmp_path)).collect()}
    changed = math.exp(sum(math.log(x) for x in (59 / 60, 57 / 59, 55 / 58, 53 / 57)) / 4)
    assert got == pytest.approx({1: 1, 2: changed, 3: math.exp(1 - 60 / 45)}, abs=1e-8)


def test_bleu(spark):
    pairs = [("x", "x"), ("the quick brown fox jumps", "the quick brown fox jumps"), ("a b c d", "e f g h"), ("", "a"), ("a", ""), ("a a a b", "a a c")]
    got = [r["bleu"] for r in metrics.bleu()(spark.createDataFrame(pairs, "reference string, candidate string")).collect()]
    assert got[0] == pytest.approx(0.001**0.25) and got[1] == pytest.approx(1) and got[2:5] == [0, 0, 0]
    assert got[5] == pytest.approx(pow(2 / 3 * 1 / 2 * 0.1 * 0.1, 0.25) * pow(2.718281828459045, 1 - 4 / 3))


def test_perplexity_means(spark):
    df = spark.createDataFrame([("m", "a", 0.5, float("inf")), ("m", "a", 1.0, 4.0), ("m", "b", None, float("inf"))], "model string, test_set string, bleu double, ppl double")
    assert sorted(map(tuple, metrics.evaluated(df).collect())) == [("m", "a", 0.75, 4.0, 2), ("m", "b", 0.0, float("inf"), 0)]
    assert df.limit(1).select(S.shown(F.col("ppl"), 2)).first()[0] == "N/A"


def test_scores_of_a_pluggable_model(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "id int, text string")
    got = metrics.scored(df, "text", lambda texts: [(float(len(t)), len(t.split())) for t in texts]).collect()
    assert [(r.nll, r.n_tokens) for r in got] == [(5.0, 3), (0.0, 0)]


def test_splits_are_disjoint_whole_and_alike_at_any_partitioning(spark):
    df = spark.range(57)
    got = [sorted((r["id"], r["split"]) for r in mix.split(df.repartition(n), "id").collect()) for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2] and sum(s == "val" for _, s in got[0]) == 5
    assert [r["split"] for r in mix.split(spark.range(1), "id").collect()] == ["val"]


def test_one_to_one(spark):
    got = mix.one_to_one(spark.range(5), spark.range(100, 103), "id").collect()
    assert sorted(r["_source"] for r in got) == ["a"] * 3 + ["b"] * 3


def test_normalised_takes_the_last_turn(spark):
    df = spark.createDataFrame([([("user", "u1"), ("assistant", "a1"), ("user", "u2")],), (None,)], "messages array<struct<role: string, content: string>>")
    assert [tuple(r) for r in mix.normalised(df).select("question", "answer", "type").collect()] == [("u2", "a1", "qa"), ("", "", "qa")]


def test_json_lines_policies(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a":1}\n{}\n\nbad\n{"a":2}\n')
    read = lambda policy: [r["a"] for r in files.read_jsonl(spark, str(p), "a int", policy).orderBy("_ord").collect()]
    assert read("skip") == [1, 2] and read("keep_empty") == [1, None, 2] and read("truncate") == [1, None]
    with pytest.raises(Exception):
        read("failfast")
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int", missing_ok=True).count() == 0
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int")


def test_ordinals_over_blocks(spark, tmp_path):
    p = tmp_path / "long.jsonl"
    p.write_text("".join(f'{{"a":{k}}}\n' if k % 7 else "bad\n" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = files.read_jsonl(spark, str(p), "a int").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.a for r in sorted(got, key=lambda r: r["_ord"])] == [k for k in range(3000) if k % 7] and sorted(r["_ord"] for r in got) == list(range(len(got)))


def test_hub_layout_and_results(spark, tmp_path):
    df = spark.createDataFrame([("qa", "x"), ("design", "y")], "type string, text string")
    files.write_hub_layout(df, str(tmp_path / "hub"))
    read = lambda p: [json.loads(x) for f in p.glob("*.json") for x in f.read_text().splitlines()]
    assert len(read(tmp_path / "hub" / "train.jsonl")) == 2 and read(tmp_path / "hub" / "dataset_info.json") == [{"total_samples": 2, "qa_samples": 1, "design_samples": 1, "format": "jsonl"}]
    assert read(__import__("pathlib").Path(files.write_results(df, str(tmp_path), "20240101_000000"))) == [{"type": "qa", "text": "x"}, {"type": "design", "text": "y"}]


def test_other_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a":1},{"a":2}]')
    (tmp_path / "b.jsonl").write_text('{"a":3}\n{}\n')
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "trainer_state.json").write_text('{"log_history":[{"step":1,"loss":0.5},{"eval_loss":0.4}]}')
    assert sorted(str(r.a) for r in files.read_any(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.jsonl")], "a int").collect()) == ["1", "2", "3", "None"]
    states = files.read_trainer_states(spark, str(tmp_path / "run1" / "trainer_state.json"))
    assert [(r.run, r.kind, r.step, r.loss) for r in metrics.loss_series(states).orderBy("kind").collect()] == [("run1", "eval", 0, 0.4), ("run1", "train", 1, 0.5)]
    assert {r.path.rsplit("/", 1)[-1]: r.size for r in files.list_files(spark, str(tmp_path), "*.jsonl").collect()} == {"b.jsonl": 11}
    (tmp_path / "README.md").write_text("hello")
    (tmp_path / "README.txt").write_text("not me")
    listing = spark.createDataFrame([("README.txt", "not me"), ("README.md", "hello")], "path string, code string")
    assert [r.code for r in repository.readme(listing).collect()] == ["hello"]


def test_folders_sinks_and_shown_rows(spark, tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    for name, text in (("a", '{"a":1}\n{"a":2}\n'), ("b", '{"a":3}\n')):
        (tmp_path / "d" / f"{name}.jsonl").write_text(text)
    got = files.read_jsonl(spark, str(tmp_path / "d" / "*.jsonl"), "a int").collect()
    assert sorted((r["_file"][-7:], r["_ord"], r.a) for r in got) == [("a.jsonl", 0, 1), ("a.jsonl", 1, 2), ("b.jsonl", 0, 3)]
    files.write_by(spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int"), str(tmp_path / "by"), "k")
    assert [json.loads(p.read_text()) for p in sorted((tmp_path / "by").glob("k=*/*.json"))] == [{"a": 1}, {"a": 2}]
    (tmp_path / "tree" / "src").mkdir(parents=True)
    (tmp_path / "tree" / "src" / "a.py").write_text("x = 1\n")
    monkeypatch.chdir(tmp_path)
    assert [(r.path, r.code) for r in repository.read_repository(spark, "tree").collect()] == [("src/a.py", "x = 1\n")] and repository.read_folder(spark, "by").count() == 0
    df = spark.createDataFrame([sample(k) for k in (3, 1, 2)], SAMPLE)
    assert [r["_ord"] for r in profile.first_rows(df, 2).collect()] == [1, 2]
    assert render.canonical(df.drop("demand")).first()[:6] == ("qa", "a question to ask", "the question is answered here", "", "", "t" * 30)
    wide = spark.createDataFrame([("m", "0.5"), ("base", "N/A")], "model string, t string")
    assert [r.line for r in metrics.markdown(wide).orderBy("ord").collect()] == ["| model | t |", "|---|---|", "| base | N/A |", "| m | 0.5 |"]
    plan = profile.routed(spark.createDataFrame([("a.log", 1), ("b.py", 1), ("c.txt", 1)], "path string, size long"), [(r"\.py$", "out")], (r"\.log$",)).collect()
    assert {(r.src, r.dst, r.action) for r in plan} == {("a.log", None, "delete"), ("b.py", "out/b.py", "move"), ("c.txt", None, "keep")}


def test_few_rules_are_topped_up(spark):
    rules, code = spark.range(100).selectExpr("id as ord", "'rule' as kind"), spark.range(30).selectExpr("id as ord", "'snippet' as kind")
    got = snippets.injected(rules, code, 25, "ord").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {"rule": 23, "snippet": 2}


def test_combinations(spark):
    general, rule, llm, none = spark.range(10), spark.range(100, 104), spark.range(200, 203), spark.range(0)
    parts = lambda df: sorted(r["_part"] for r in df.collect())
    assert parts(mix.combined("all", general, rule, llm, "id")) == ["general"] * 7 + ["llm"] * 3 + ["rule"] * 4
    assert parts(mix.combined("all", general, rule, none, "id")) == ["general"] * 4 + ["rule"] * 4
    assert parts(mix.combined("general_llm", general, rule, llm, "id")) == ["general"] * 3 + ["llm"] * 3
    assert mix.feasible(["all", "general_llm"], general, rule, none) == ["all"]
    for bad in (lambda: mix.combined("general_llm", general, rule, none, "id"), lambda: mix.combined("other", general, rule, llm, "id"), lambda: mix.feasible(["all"], none, none, none)):
        with pytest.raises(ValueError):
            bad()


def test_demands_are_filled_up(spark):
    every = spark.createDataFrame([(k, f"demand {k}") for k in range(4)], "id long, demand string")
    got = [r.demand for r in mix.filled_up(every.where("id < 2"), every, 9, "demand", "id").collect()]
    assert len(got) == 9 and got[:2] == ["demand 0", "demand 1"] and all(g[8] == " " and g[9:] in mix.fixed.VARIANT_MARKERS for g in got[2:])
    assert mix.filled_up(every, every, 3, "demand", "id").count() == 3


def test_prompts_name_what_there_is(spark):
    rule = spark.createDataFrame([("function_rule", "f", "C", "x > 1", "a.py", 3, None, "c" * 2000), ("odd", None, None, None, None, None, None, None)], "type string, name string, class_name string, condition string, file_path string, line_start int, line_end int, code string")
    full, bare = (r.prompt for r in prompts.for_rules(rule, F.lit("too short")).collect())
    assert "上下文信息:\n所属类: C\n函数名: f\n条件表达式: x > 1\n" in full and "代码行号: 3-13\n" in full and "   - 函数名: f\n   - 类名: C\n" in full and "c" * 1000 in full and "c" * 1001 not in full and full.endswith("失败原因：too short\n请根据以上原因改进生成，确保满足所有要求。")
    assert "规则类型: odd\n" in bare and "代码行号: 1-11\n上下文信息:\n无\n" in bare and "   - \n   - \n" in bare
    assert "失败原因" not in prompts.for_rules(rule).first().prompt


def test_prompt_by_template_and_tokens(spark):
    rows = spark.createDataFrame([([("system", "s"), ("user", "u"), ("assistant", 'a"')],)], "conversation array<struct<role: string, content: string>>")
    assert render.prompted(rows).first().prompt == '<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na"<|im_end|>\n<|im_start|>assistant\n'
    assert render.prompted(rows, template=lambda ms: "|".join(f"{m['role']}={m['content']}" for m in ms)).first().prompt == 'user=u|assistant=a"'
    got = render.tokenised(spark.createDataFrame([("a bb ccc",), (None,)], "text string"), "text", lambda ts: [[len(w) for w in t.split()] for t in ts], 2).collect()
    assert [(list(r.input_ids), list(r.labels)) for r in got] == [([1, 2], [1, 2]), ([], [])]


RULE = "ord long, type string, name string, condition string, parameters array<string>, bases array<string>, file_path string, line_start int, line_end int, code string, docstring string, description string"


def test_cycled_questions_and_halves(spark):
    rules = spark.createDataFrame([(0, "function_rule", "f", None, ["x"], None, "a.py", 1, 2, "def f(x): pass", "", "Function: f(x)"), (1, "comment_rule", None, None, None, None, "a.py", 5, 5, "# todo", "", "a note")], RULE)
    code = spark.createDataFrame([(0, "s.py", "def g(): pass", "python"), (1, "t.py", "x = 1", "python"), (2, "u.go", "func f", "go")], "ord long, file_path string, code string, language string")
    got = snippets.cycled(rules, code, 100).collect()
    questions = [r.question for r in got]
    assert len(set(questions)) == len(questions) and [r.variant for r in got] == sorted(r.variant for r in got) and questions[-1] == "What does the function g do in s.py?"
    assert sum("(variant" in q for q in questions) in (0, 10) and snippets.cycled(rules, code, 2).count() == 2
    both = snippets.halves(rules, code, 4, repository="r").collect()
    assert len(both) == 4 and sum(r.code_snippets[0].file_path == "a.py" for r in both) == 2


def test_design_responses_name_their_files(spark):
    rows = [('{"scheme": "extend 现有代码", "reasoning_trace": {"steps": [{"step": 1, "action": "a", "evidence": "该代码", "conclusion": "c"}], "summary": "s"}}', [("p.py",)]), ("", [("p.py",)]), ("plain 现有代码", None)]
    got = responses.read_designs(spark.createDataFrame(rows, "response string, code_snippets array<struct<file_path: string>>")).collect()
    assert got[0].scheme == "extend p.py文件中的代码" and got[0].trace.steps[0].evidence == "p.py文件中的代码" and got[0].trace.summary == "s" and got[0].integration_points == []
    assert got[1].scheme == "Generated by LLM" and len(got[1].trace.steps) == 3 and got[2].scheme == "plain 现有代码"


def test_unvalidated_loop(spark):
    prompts = spark.createDataFrame([(0, "a"), (1, "")], "ord long, prompt string")
    got = responses.unvalidated(prompts, lambda ps: [p * 2 for p in ps], 3, "ord").collect()
    assert [(r.response, r.variant) for r in got] == [("aa", 0), ("aa", 1)]


@pytest.mark.parametrize("rows", [0, 10, 39, 40, 120, 200])
def test_variants_of_any_number_of_rows(spark, tmp_path, rows):
    """The first hundred of three passes over the whole table, ids without a value last."""
    ids = [None if k % 20 == 3 else k // 2 for k in range(rows)]
    spark.createDataFrame([(i, "t") for i in reversed(ids)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [(r.item_id, r.variant) for r in catalogue.queries()["replicate_variants"](spark, str(tmp_path)).collect()]
    key = lambda r: (r[1], r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(((i, v) for i in ids for v in range(3)), key=key)[:100]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("qa", "é", None), ("design", "b", "c")], "type string, a string, b string")
    files.write_jsonl(df, str(tmp_path / "out"), 1)
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"type": "qa", "a": "é"}, {"type": "design", "a": "b", "b": "c"}]
    assert json.loads(files.json_array(df, "a").first()[0])[0]["a"] == "b"
    assert tuple(files.dataset_info(df).first()) == (2, 1, 1)
    assert files.read_parquet(spark, str(tmp_path / "none"), "a int").count() == 0


def test_repository(spark, tmp_path):
    for name, text in {"src/a.py": "class A(B):\n    def f(self): pass\n", "b.py": "if x:\n    y = 1\n", "test_c.py": "x", "node_modules/d.py": "x", "tests/e.py": "x", "f.txt": "x", "g.py": "", "h.py": "y" * 102401, ".i/j.py": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root = tmp_path.rename(tmp_path.parent / "tree")
    got = repository.read_folder(spark, str(root), 10).orderBy(F.desc("path")).collect()
    assert [(r.path, r.language) for r in got] == [("src/a.py", "python"), ("b.py", "python")]
    rules = extract.rules(spark.createDataFrame(got)).collect()
    assert sorted(r.type for r in rules) == ["class_rule", "conditional_rule", "function_rule"]
    samples = generate.samples(extract.rules(spark.createDataFrame(got)), "r").collect()
    assert all(len(s.question) >= 10 and len(s.answer) >= 20 and len(s.trace_text) >= 30 for s in samples)


def test_tree_over_http(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "tree.json").write_text(json.dumps({"tree": [{"path": "a.py", "type": "blob"}, {"path": "tests/b.py", "type": "blob"}, {"path": "src", "type": "tree"}, {"path": "gone.py", "type": "blob"}]}))
    got = repository.read_tree(spark, [f"file://{tmp_path}/none.json", f"file://{tmp_path}/tree.json"], [f"file://{tmp_path}/"] * 2).orderBy("path").collect()
    assert [(r.path, r.code, r.error is None) for r in got] == [("a.py", "x = 1\n", True), ("gone.py", None, False)]


def test_json_in_responses(spark):
    rows = [('x {"question": "q", "answer": "a {b}"} y',), ("```json\n{'question': 'q', 'answer': 'a',}\n```",), ("Question: q?\nmore\nAnswer: a",), ("plain",), (None,), ('{"question": {"answer": 1}} {"answer": "z"',)]
    got = responses.read_responses(spark.createDataFrame(rows, "response string").withColumn("file_path", F.lit("f"))).collect()
    assert [(r.question, r.answer) for r in got][:5] == [("q", "a {b}"), ("q", "a"), ("q?\nmore", "a"), ("", "plain"), ("", "")]
    assert list(responses.balanced('a {"x": "}"} {')) == ['{"x": "}"}']


def test_loop_is_bounded_and_hands_failures_back(spark):
    todo = spark.range(6).withColumnRenamed("id", "rule_id")

    def step(rows, failures):
        n = rows.withColumn("n", F.lit(0)) if failures is None else rows.join(failures.groupBy("rule_id").agg(F.count("*").cast("int").alias("n")), "rule_id", "left")
        return n.withColumn("ok", F.col("rule_id") <= F.coalesce("n", F.lit(0))).withColumn("reasons", F.array(F.lit("too early")))

    assert sorted(r.rule_id for r in responses.until_valid(todo, step, 10).collect()) == [0, 1, 2]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([sample(0, q="why is the sky blue", a="it is blue because of the sky"), sample(1, q="why is the sky blue", a="it is blue because of the sky"), sample(2, q="short")], SAMPLE).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    q = dedup.valid_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts").writeStream.format("memory").queryName("valid").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from valid").first()[0] == 1


def test_stream_keeps_variants_as_a_batch_does(spark, tmp_path):
    q, a = "why is the sky blue", "it is blue because of the sky"
    rows = spark.createDataFrame([sample(0, q=q, a=a), sample(1, q=q + " (variant 1)", a=a), sample(2, q=q + " (variant 2)", a=a), sample(3, q=q, a=a), sample(4, q="why is the sea blue (variant 1)", a=a), sample(5, kind="design", q="design a blue sky", a=a)], SAMPLE)
    rows = rows.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = dedup.valid_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts").writeStream.format("memory").queryName("variants").option("checkpointLocation", str(tmp_path / "cp")).start()
    s.processAllAvailable()
    s.stop()
    got = {r["_ord"] for r in spark.sql("select _ord from variants").collect()}
    batch = {r["_ord"] for r in validate.validate(rows).collect()}
    assert batch == {0, 1, 2, 4, 5} and {1, 2, 4, 5} <= got and len(got & {0, 3}) == 1 and got <= batch | {3}


def test_mode_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4)], "lang string, ord int")
    assert profile.mode(df, "lang", "ord", "python").first()[0] == "b"
    assert profile.mode(df.limit(0), "lang", "ord", "python").first()[0] == "python"
