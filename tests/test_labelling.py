from topicloom.plans import labelling as lab


def words(spark):
    return spark.createDataFrame([(0, "lampe", 0.9), (0, "licht", 0.5), (1, "brunnen", 0.7)], "topic_id int, word string, weight double")


def examples(spark):
    return spark.createDataFrame([(0, 1, "x" * 300), (0, 2, "zwei")], "topic_id int, rank int, text string")


def test_prompts(spark):
    got = {r["topic_id"]: r["prompt"] for r in lab.label_prompts(words(spark), examples(spark)).collect()}
    assert "lampe, licht" in got[0] and "1. " + "x" * 200 + "\n2. zwei" in got[0]
    assert "1. brunnen" in got[1]  # no examples: keywords stand in


def test_labels_and_fallback(spark):
    prompts = lab.label_prompts(words(spark), examples(spark))
    named = lab.apply_labeler(prompts, lambda ps: ['"Defekte Lampe"' for _ in ps])
    assert {r["label"] for r in named.collect()} == {"Defekte Lampe"}

    def fail(prompts):
        raise RuntimeError("no service")

    got = {r["topic_id"]: r["label"] for r in lab.apply_labeler(prompts, fail).collect()}
    assert got == {0: "lampe licht", 1: "brunnen"}


def shouting():
    def shout(prompts):
        """Upper-case the text after the marker; of a single word it makes two."""
        out = []
        for p in prompts:
            text = p.split("German: ")[-1].split("Keywords: ")[-1].split("\n")[0]
            out.append("English: " + text.upper() if "," in text else text.upper() + ", extra")
        return out

    return shout


def test_word_translation_with_mismatch(spark):
    got = lab.translate_topic_words(words(spark), shouting(), examples(spark)).collect()
    assert sorted(r["word"] for r in got) == ["LAMPE", "LICHT", "brunnen"]


def test_words_without_reports_are_translated_in_batches(spark):
    many = spark.createDataFrame([(i % 3, f"w{i:02}", 1.0) for i in range(45)] + [(0, "w44", 0.5)], "topic_id int, word string, weight double")
    asked = spark.sparkContext.accumulator(0)

    def shout(prompts):
        asked.add(len(prompts))
        if len(prompts) > 1 or any("w20" in p for p in prompts):
            raise RuntimeError("no such batch")
        return [p.split("German: ")[-1].split("\n")[0].upper() for p in prompts]

    got = sorted(r["word"] for r in lab.translate_topic_words(many, shout).collect())
    # The batch of w20 to w39 fails and keeps its words; the other two do not suffer.
    assert got == sorted([f"W{i:02}" if not 20 <= i < 40 else f"w{i:02}" for i in range(45)] + ["W44"])


def test_a_bad_prompt_costs_only_its_own_answer(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(30)] + [(99, None)], "i int, prompt string").coalesce(1)

    def fn(texts):
        if "p7" in texts:
            raise RuntimeError("bad prompt")
        return [t.upper() for t in texts][: 1 if len(texts) == 1 else -1]

    got = {r["i"]: (r["answer"], r["failed"]) for r in lab.call_text_function(prompts, fn).collect()}
    assert got[7] == (None, True) and got[99] == (None, False)
    assert all(got[i] == (f"P{i}", False) for i in range(30) if i != 7)


def test_run_labelling(spark):
    docs = spark.createDataFrame([(7, 0), (8, 1), (9, 4)], "doc_id int, dominant_topic int")
    out = lab.run_labelling(words(spark), docs, examples(spark), "bow", translator=lambda ps: ["lit lamp" for _ in ps])
    de = {r["doc_id"]: r["dominant_topic_name"] for r in out["de"][1].collect()}
    en = {r["doc_id"]: r["dominant_topic_name"] for r in out["en"][1].collect()}
    assert de == {7: "lampe licht", 8: "brunnen", 9: "Topic 4"}
    assert en == {7: "Lit lamp", 8: "Lit lamp", 9: "Topic 4"}


def test_run_cluster_labelling(spark):
    info = spark.createDataFrame(
        [(-1, 1, "-1_a", [("a", 1.0)]), (0, 2, "0_lampe", [("lampe", 0.9), ("licht", 0.5)])],
        "topic_id int, count long, name string, representation array<struct<word:string,score:double>>",
    )
    docs = spark.createDataFrame([(7, 0), (8, -1)], "doc_id int, topic_id int")
    out = lab.run_cluster_labelling(info, docs, words(spark), examples(spark), translator=shouting())
    assert {r["doc_id"]: r["topic_name"] for r in out["de"][1].collect()} == {7: "0_lampe licht", 8: "-1_a"}
    en = {r["topic_id"]: (r["name"], [x["word"] for x in r["representation"]]) for r in out["en"][0].collect()}
    assert en[0] == ("0_LAMPE LICHT, extra", ["LAMPE", "LICHT"]) and en[-1] == ("-1_a", ["a"])
