from datetime import datetime

from pyspark.sql import functions as F

from glossaleaf.languages import Languages
from glossaleaf.operators import langid
from glossaleaf.plans import analysis
from glossaleaf.schemas import DIARY_ENTRIES
from glossaleaf.sources import given

ECHO_PAIR = "<bracket>[text]</bracket><translation>corresponding translation</translation>"
ECHO_ERROR = "<error><rule>r</rule><correction>c</correction></error>"
FRENCH = "Hier je allé au marché avec ma [aunt]. Il y avait beaucoup de [fresh vegetables] partout."
CHINESE = "昨天我去了[market]买东西。我喜欢[fresh vegetables]。"


def key(second):
    return f"2024-01-02_2024-01-02T03:04:{second:02}"


def chain_inputs(spark):
    at = [datetime(2024, 1, 2, 3, 4, s) for s in range(4)]
    submitted = spark.createDataFrame(
        [
            ("j0", at[0], FRENCH, "fra", "eng", "B2", "", True, False),
            ("j1", at[1], CHINESE, " zho", "eng", "A2", "t", True, True),
            ("j2", at[2], FRENCH, "fra", "eng", "Z9", "", True, True),
            ("j3", at[3], "[aa] aa", "fra", "eng", "B2", "", True, True),
        ],
        "job_id string, submitted_at timestamp_ntz, draft_text string, lang_diary_body string, lang_annotation string, "
        "level_rewriting string, title_diary string, rewriter_is_execute boolean, reviewer_is_execute boolean",
    )

    def pairs(*items):
        return ECHO_PAIR + "".join(f"<bracket>{o}</bracket><translation>{t}</translation>" for o, t in items)

    translator = spark.createDataFrame(
        [
            (key(0), pairs(("[aunt]", "tante"), ("[fresh vegetables]", "légumes frais"))),
            (key(1), pairs(("[market]", "市场"), ("[fresh vegetables]", "新鲜蔬菜"))),
            (key(3), "<bracket>[aa]</bracket><translation>x</translation>"),
        ],
        "primary_id string, response string",
    )
    found = (
        "<error><rule>verb</rule><phrase>je allé</phrase><correction>je suis allé</correction><category>Grammar</category></error>"
        "<error><rule>none</rule><phrase>a</phrase><correction>a</correction><category>Grammar</category></error>"
        "<error><rule>style</rule><phrase>a</phrase><correction>b</correction><category>Style</category></error>"
    )
    archivist = spark.createDataFrame([(key(0), ECHO_ERROR + found), (key(3), ECHO_ERROR + found)], translator.schema)
    attempts = spark.createDataFrame(
        [
            (key(0), 1, "no tag", "stop", "fra"),
            (key(0), 2, "<rewriting>Hier je suis allé au [marché].</rewriting>", "stop", "fra"),
            (key(1), 1, "<rewriting>中文</rewriting>", "stop", "jpn"),
        ],
        "primary_id string, attempt int, response string, finish_reason string, detected_language string",
    )
    reviews = spark.createDataFrame([(key(0), "<review>r0</review>"), (key(1), "<review>r1</review>")], translator.schema)
    return [submitted, translator, archivist, attempts, reviews]


def run(spark, inputs=None):
    return analysis.analyse(*(inputs or chain_inputs(spark)), Languages(spark), "tutor", "embedder")


def test_whole_chain(spark):
    done = run(spark)
    entries = {r.primary_id: r for r in done.entries.collect()}
    assert set(entries) == {key(0), key(1), key(3)}
    first = entries[key(0)]
    assert first.diary_replaced == "Hier je allé au marché avec ma tante. Il y avait beaucoup de légumes frais partout."
    assert first.diary_rewritten == "Hier je suis allé au marché."
    assert (first.language_source, first.is_show, first.current_version) == ("fra", True, 0)
    assert entries[key(1)].diary_rewritten == "<rewriting>中文</rewriting>"
    assert (entries[key(3)].diary_replaced, entries[key(3)].diary_rewritten) == ("", "")
    assert done.entries.columns == DIARY_ENTRIES.fieldNames()

    assert sorted(r.expression for r in done.expressions.collect()) == ["[aunt]", "[fresh vegetables]", "[fresh vegetables]", "[market]"]
    errors = done.errors.collect()
    assert [r.page_content for r in errors] == ["Grammar Error: verb. Example: 'je allé' -> 'je suis allé'"]
    assert [r.reject_reason for r in done.errors_rejected.collect()] == ["category"]
    assert {r.primary_id: r.total_review for r in done.reviews.collect()} == {key(0): "", key(1): "r1", key(3): ""}
    states = {r.job_id: (r.status, r.message) for r in done.status.collect()}
    assert states == {"j0": ("completed", ""), "j1": ("completed", ""), "j2": ("error", "invalid level"), "j3": ("completed", "")}
    assert [(r.job_id, r.reject_reason) for r in done.rejected.collect()] == [("j2", "invalid level")]


def test_a_second_job_with_one_key_is_refused_before_any_join(spark):
    inputs = chain_inputs(spark)
    twice = inputs[0].unionByName(inputs[0].filter("job_id in ('j0', 'j1')").withColumn("job_id", F.concat("job_id", F.lit("b"))))
    stored = spark.createDataFrame([(key(3),)], "primary_id string")
    done = analysis.analyse(twice, *inputs[1:], Languages(spark), "tutor", "embedder", stored=stored)
    assert sorted(r.primary_id for r in done.entries.collect()) == [key(0), key(1)]
    assert done.expressions.count() == 4 and done.reviews.count() == 2
    states = {r.job_id: r.status for r in done.status.collect()}
    assert states == {"j0": "completed", "j1": "completed", "j2": "error", "j3": "error", "j0b": "error", "j1b": "error"}


def test_past_errors_reach_the_entry_and_new_ones_are_embedded(spark):
    # local, so that it travels to the workers by value
    def vowels(texts):
        if any("unreadable" in t for t in texts):
            raise ValueError("no vector")
        return [[float(t.count(v)) for v in "aeiou"] for t in texts]

    columns = "primary_id_DiaryEntry string, model_id_embedding string, language_diary_text string, language_annotation_text string, page_content string"
    same = ("old", "embedder", "fra", "eng")
    stored = spark.createDataFrame(
        [(*same, "Grammar Error: verb. Example: 'je allé' -> 'je suis allé'"), (*same, "far away"), (*same, "unreadable"),
         ("old", "embedder", "deu", "eng", "another language"), ("old", "other model", "fra", "eng", "another model")],
        columns,
    )
    from glossaleaf.operators import models

    remembered = models.embed(stored, "page_content", vowels, empty_on_error=True)
    done = analysis.analyse(
        *chain_inputs(spark), Languages(spark), "tutor", "embedder", embed=vowels, remembered=remembered
    )
    assert [len(r.embedding) for r in done.errors.collect()] == [5]
    past = {r.primary_id_DiaryEntry: r.past for r in done.past.collect()}
    assert past == {key(0): ["Grammar Error: verb. Example: 'je allé' -> 'je suis allé'", "far away"]}
    # without a memory nothing is found; without a model nothing is searched
    empty = analysis.analyse(*chain_inputs(spark), Languages(spark), "tutor", "embedder", embed=vowels)
    assert empty.past.count() == 0 and empty.errors.count() == 1
    assert run(spark).past is None


def test_all_iso_codes(spark, tmp_path):
    import json

    from glossaleaf import languages
    from glossaleaf.operators import intake

    listed = [{"alpha_3": "fra", "alpha_2": "fr", "name": "French", "scope": "I"}, {"alpha_3": "yue", "name": "Yue Chinese"}, {"alpha_3": "eng", "alpha_2": "en", "name": "English"}]
    (tmp_path / "iso.json").write_text(json.dumps({"639-3": listed}))
    known = Languages(spark, languages.from_iso_codes(spark, str(tmp_path / "iso.json")))
    sent = chain_inputs(spark)[0].filter("job_id = 'j0'").withColumn("lang_diary_body", F.lit("yue"))
    assert intake.valid(intake.checked(sent, known)).count() == 1
    assert intake.valid(intake.checked(sent, Languages(spark))).count() == 0


def test_stored_keys_are_refused(spark):
    done = run(spark)
    accepted, refused = analysis.save_new(done.entries.filter(f"primary_id = '{key(0)}'"), done)
    assert accepted.count() == 2 and [r.primary_id for r in refused.collect()] == [key(0)]


def test_blank_codes_are_detected(spark, sf_dir):
    profile = langid.train(given.base(spark, sf_dir), "text", "language_source")
    documents = given.base(spark, sf_dir).filter("language_source in ('fra', 'deu')")
    blank = documents.selectExpr(
        "primary_id", "language_source as want", "concat(text, ' [this with that and the other]') as draft_text",
        "'' as lang_diary_body", "'eng' as lang_annotation",
    )
    got = analysis.with_languages(blank, profile).collect()
    right = sum(r.language_source == r.want for r in got)
    assert right / len(got) > 0.95 and {r.language_annotation for r in got} == {"eng"}


def test_attempt_languages_are_detected(spark, sf_dir):
    from glossaleaf.operators import rewriting

    base = given.base(spark, sf_dir)
    profile = langid.train(base, "text", "language_source")
    attempts = base.selectExpr(
        "primary_id", "language_source", "explode(array(1, 2, 6)) as attempt", "text", "'stop' as finish_reason"
    ).selectExpr("*", "if(attempt = 2, text, concat('<rewriting>', text, '</rewriting>')) as response")
    got = rewriting.with_detected_language(attempts, "primary_id", profile).collect()
    assert all(r.detected_language is None for r in got if r.attempt != 1)
    first = [r for r in got if r.attempt == 1]
    assert sum(r.detected_language == r.language_source for r in first) / len(first) > 0.95


def test_stream_of_submissions_equals_batch(spark, tmp_path):
    """Submissions that arrive one file at a time give the tables of one batch run."""
    from glossaleaf.streaming import submissions

    inputs = chain_inputs(spark)
    submitted = inputs[0]
    for i, row in enumerate(submitted.collect()):
        spark.createDataFrame([row], submitted.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = (
        spark.readStream.schema(submitted.schema).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    )

    def step(batch):
        done = run(spark, inputs=[batch, *inputs[1:]])
        return {"entries": done.entries, "expressions": done.expressions, "rejected": done.rejected}

    submissions.run_batches(stream, step, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    whole = run(spark)
    for name, table in (("entries", whole.entries), ("expressions", whole.expressions), ("rejected", whole.rejected)):
        streamed = spark.read.parquet(f"{tmp_path}/out/{name}").select(*table.columns)
        assert sorted(map(str, streamed.collect())) == sorted(map(str, table.collect()))
