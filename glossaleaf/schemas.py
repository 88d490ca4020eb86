"""Table schemas and closed value sets of the diary store."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
CEFR_LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]
ERROR_CATEGORIES = ["Grammar", "Vocabulary", "Spelling", "None"]
JOB_STATES = ["completed", "error", "processing"]
TASKS = ["translator", "archivist", "rewriter", "reviewer"]

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# times are wall-clock times without a zone
_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampNTZType()

DIARY_ENTRIES = _table(
    primary_id=_S, created_at=_TS, date_diary=T.DateType(), language_source=_S,
    language_annotation=_S, diary_original=_S, diary_replaced=_S, diary_rewritten=_S,
    level_rewriting=_S, model_id_tutor=_S, title_diary=_S, current_version=_I,
    is_show=T.BooleanType(),
)
UNKNOWN_EXPRESSIONS = _table(
    primary_id=_S, primary_id_DiaryEntry=_S, created_at=_TS, expression=_S,
    expression_translation=_S, span_original=SPAN, span_translation=SPAN,
    language_source=_S, language_annotation=_S,
)
VERSION_HISTORY = _table(
    history_id=_S, primary_id_DiaryEntry=_S, version_from=_I, version_to=_I,
    created_at=_TS, changes=_S,
)
ERROR_MEMORY = _table(
    primary_id_DiaryEntry=_S, model_id_embedding=_S, language_diary_text=_S,
    language_annotation_text=_S, error_rule=_S, example_phrase=_S, correction=_S,
    category=_S, page_content=_S, embedding=T.ArrayType(T.FloatType()),
)
STATUS_EVENTS = _table(job_id=_S, diary_id=_S, ts=_TS, status=_S, message=_S)
SUBMISSIONS = _table(
    job_id=_S, submitted_at=_TS, draft_text=_S, lang_diary_body=_S, lang_annotation=_S,
    level_rewriting=_S, title_diary=_S,
)
