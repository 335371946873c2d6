"""What a run leaves behind beside its subtitles: one nested document for each job, messages, a report, and waveforms as JSON."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, MapType, StringType, StructField, StructType, VariantType

from cuewright.sources.lines import job_of

KINDS = {"string": StringType(), "double": DoubleType(), "int": IntegerType()}


def _struct(fields: str) -> StructType:
    return StructType([StructField(name, KINDS[kind]) for name, kind in (f.split(":") for f in fields.split())])


_UNIT = _struct("text:string start:double end:double")
_MATCH = _struct("cue_index:int source_text:string transcript_text:string start:double end:double similarity:double coverage:double exact_characters:int status:string")
_MOVE = _struct(
    "cue_index:int kind:string original_start:double refined_start:double transcript_start:double previous_transcript_end:double "
    "local_start:double global_start:double local_end:double global_end:double"
)
_GAP = _struct("after_cue_index:int text:string start:double end:double")
_TEXT = StringType()
#: The document of a job. Maps are keyed by the line's index as text.
DOCUMENT = StructType(
    [
        StructField("job_id", _TEXT),
        StructField("audio", _TEXT),
        StructField("duration", DoubleType()),
        StructField("backend", _TEXT),
        StructField("model", _TEXT),
        StructField("language", _TEXT),
        StructField("detected_language", _TEXT),
        StructField("device", _struct("whisper:string separation:string reason:string")),
        StructField("settings", VariantType()),
        StructField("transcript_units", ArrayType(_UNIT)),
        StructField("transcript_matches", ArrayType(_MATCH)),
        StructField("auto_hidden_gaps", ArrayType(_GAP)),
        StructField("manual_hidden_indices", ArrayType(IntegerType())),
        StructField("global_units", ArrayType(_UNIT)),
        StructField("local_cues", MapType(_TEXT, _UNIT)),
        StructField("local_units", MapType(_TEXT, ArrayType(_UNIT))),
        StructField("start_adjustments", ArrayType(_MOVE)),
        StructField("hidden_timing_cues", ArrayType(_UNIT)),
        StructField("raw_cues", ArrayType(_UNIT)),
        StructField("cues", ArrayType(_UNIT)),
        StructField("messages", ArrayType(_TEXT)),
    ]
)


def _field(name: str) -> str:
    kind = next(f.dataType for f in DOCUMENT.fields if f.name == name)
    return kind.simpleString()


def _rows(table: DataFrame, order: str, name: str) -> DataFrame:
    """(job_id, name): the rows of each job in order, as the document has them."""
    fields = next(f.dataType for f in DOCUMENT.fields if f.name == name).elementType.names
    item = F.struct(*[F.col("cue_idx" if c == "cue_index" else c).alias(c) for c in fields])
    return table.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), item.alias("v")))).alias("_all")).select("job_id", F.transform("_all", lambda x: x["v"]).cast(_field(name)).alias(name))


def documents(
    jobs: DataFrame,
    transcript_units: DataFrame,
    matches: DataFrame,
    lines: DataFrame,
    global_units: DataFrame,
    local_cues: DataFrame,
    local_units: DataFrame,
    moves: DataFrame,
    raw_cues: DataFrame,
    cues: DataFrame,
    messages: DataFrame,
    settings: dict[str, object] | None = None,
    hidden_cues: DataFrame | None = None,
) -> DataFrame:
    """One row of ``DOCUMENT`` for each of ``jobs``. A job's part of each table becomes one array or map.

    ``jobs`` has job_id, and of audio, duration, backend, model, language, detected_language and device (struct of whisper, separation, reason) what is
    known. ``settings`` keep their types. No table has automatic gaps, as no rule makes any.
    """
    scalars = [f.name for f in DOCUMENT.fields if f.name not in ("job_id", "settings") and f.dataType.typeName() not in ("array", "map")]
    jobs = jobs.select("job_id", *[F.col(c) if c in jobs.columns else F.lit(None).cast(_field(c)).alias(c) for c in scalars]).withColumn("auto_hidden_gaps", F.array().cast(_field("auto_hidden_gaps")))
    local = local_cues.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("cue_idx").cast("string"), F.struct("text", "start", "end")))).cast(_field("local_cues")).alias("local_cues"))
    by_line = local_units.groupBy("job_id", "cue_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("unit_idx", "text", "start", "end"))), lambda u: F.struct(u["text"].alias("text"), u["start"].alias("start"), u["end"].alias("end"))).alias("_u"))
    heard = by_line.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("cue_idx").cast("string"), "_u"))).cast(_field("local_units")).alias("local_units"))
    hidden = lines.filter("hidden").groupBy("job_id").agg(F.sort_array(F.collect_list(F.col("cue_idx").cast("int"))).alias("manual_hidden_indices"))
    said = messages.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("kind", F.col("cue_idx"), "payload"))).alias("_m")).select("job_id", F.transform("_m", lambda m: F.concat_ws(" ", m["kind"], m["payload"])).alias("messages"))
    parts = [
        _rows(transcript_units, "unit_idx", "transcript_units"),
        _rows(matches, "cue_idx", "transcript_matches"),
        _rows(global_units, "unit_idx", "global_units"),
        _rows(moves, "cue_idx", "start_adjustments"),
        _rows(raw_cues, "cue_idx", "raw_cues"),
        _rows(cues, "cue_idx", "cues"),
        _rows(raw_cues.limit(0) if hidden_cues is None else hidden_cues, "cue_idx", "hidden_timing_cues"),
        local,
        heard,
        hidden,
        said,
    ]
    rows = reduce(lambda a, b: a.join(b, "job_id", "left"), parts, jobs)
    rows = rows.withColumn("settings", F.parse_json(F.lit(json.dumps(settings))) if settings is not None else F.lit(None).cast("variant"))
    return rows.select(*[F.coalesce(F.col(f.name).cast(f.dataType), F.array().cast(f.dataType)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields])


def write_documents(found: DataFrame, path: str) -> None:
    """One JSON object a line. Rows of ``scan_documents`` are written as they were read, with fields that no column holds."""
    if "document" in found.columns:
        found.select(F.to_json("document").alias("value")).write.text(path)
    else:
        found.write.json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents with their full schema; JSON over several lines is read as well."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def scan_documents(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents of any writer, and those that are none.

    The first table has ``source`` (the file), the columns of ``DOCUMENT``, and ``document``, the whole as VARIANT: fields that no column knows,
    and the types of settings, live there. Without a ``job_id`` of its own a document has its file's name. The second has (source, reason, raw):
    text that is no JSON object, and documents with a known field of another type, which is named. No document stops the scan.
    ``lines``: a document a line, else a file.
    """
    texts = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", "^\uFEFF", "").alias("raw"))
    texts = texts.filter(F.trim("raw") != "").withColumn("document", F.try_parse_json("raw"))
    kinds = {f.name: f.dataType.simpleString() for f in DOCUMENT.fields}
    name = job_of(F.col("source"))
    given = {c: F.try_variant_get("document", f"$.{c}", kind) for c, kind in kinds.items()}
    # A field that is there, is not null, and has no value of its type.
    part = lambda c: F.try_variant_get("document", f"$.{c}", "variant")
    there = lambda c: part(c).isNotNull() & ~F.is_variant_null(part(c))
    wrong = F.array_compact(F.array(*[F.when(there(c) & given[c].isNull(), F.lit(c)) for c in kinds]))
    is_object = F.coalesce(F.schema_of_variant("document").startswith("OBJECT"), F.lit(False))
    reason = F.when(F.col("document").isNull(), "not JSON").when(~is_object, "not an object").when(F.size(wrong) > 0, F.concat(F.lit("of another type: "), F.array_join(wrong, ", ")))
    rows = texts.withColumn("reason", reason)
    known = {**given, "job_id": F.coalesce(given["job_id"], name)}
    return rows.filter("reason IS NULL").select("source", *[v.alias(c) for c, v in known.items()], "document"), rows.filter("reason IS NOT NULL").select("source", "reason", "raw")


def units_of(found: DataFrame, name: str = "global_units") -> DataFrame:
    """Units (job_id, unit_idx, text, start, end) out of documents."""
    return found.select("job_id", F.posexplode(name).alias("unit_idx", "u")).select("job_id", "unit_idx", "u.*")


def report(matches: DataFrame, whole: DataFrame, local: DataFrame) -> DataFrame:
    """A line of text for each source line: its status, the three times, and REVERSE where the chosen start lies 0.01 before an earlier one."""
    times = lambda rows, name: rows.select("job_id", "cue_idx", F.col("start").alias(f"{name}_a"), F.col("end").alias(f"{name}_b"))
    rows = matches.join(times(whole, "g"), ["job_id", "cue_idx"], "left").join(times(local, "l"), ["job_id", "cue_idx"], "left")
    chosen = F.coalesce("l_a", "g_a")
    before = Window.partitionBy("job_id").orderBy("cue_idx").rowsBetween(Window.unboundedPreceding, -1)
    reverse = F.coalesce(chosen + 0.01 < F.greatest(F.max(chosen).over(before), F.lit(-1.0)), F.lit(False))
    stamp = lambda a, b: F.when(F.col(a).isNull(), "-").otherwise(F.format_string("%7.2f-%7.2f", a, b))
    text = F.format_string("%02d %-7s ASR %s G %s L %s%s | %s", F.col("cue_idx") + 1, "status", stamp("start", "end"), stamp("g_a", "g_b"), stamp("l_a", "l_b"), F.when(reverse, " REVERSE").otherwise(""), "source_text")
    return rows.select("job_id", "cue_idx", reverse.alias("reverse"), text.alias("line"))


def full_report(lines: DataFrame, cues: DataFrame, messages: DataFrame) -> DataFrame:
    """(job_id, part, at, line): the source lines of ``report``, then the final cues, numbered from 1, then the messages, in order."""
    job = Window.partitionBy("job_id")
    number = F.row_number().over(job.orderBy("cue_idx"))
    shown = cues.select("job_id", number.alias("at"), F.format_string("%02d %7.2f-%7.2f | %s", number, "start", "end", "text").alias("line"))
    said = messages.select("job_id", F.row_number().over(job.orderBy("kind", "cue_idx", "payload")).alias("at"), F.concat_ws(" ", "kind", "payload").alias("line"))
    parts = [lines.select("job_id", (F.col("cue_idx") + 1).cast("int").alias("at"), "line"), shown, said]
    named = [p.select("job_id", F.lit(name).alias("part"), "at", "line") for name, p in zip(("line", "cue", "message"), parts, strict=True)]
    return reduce(DataFrame.unionByName, named)


def messages(unresolved: DataFrame, matches: DataFrame, lines: DataFrame, moves: DataFrame, rejected: DataFrame, splits: DataFrame) -> DataFrame:
    """(job_id, kind, cue_idx, payload). Lines without times, changed lines of a similarity under 0.78 and weak ones (hidden lines
    aside), lines out of order, and counts (cue_idx null) of moved starts by rule and of ``splits`` (job_id, kind, n)."""
    none = F.lit(None).cast("int")
    visible = matches.join(lines.select("job_id", "cue_idx", "hidden"), ["job_id", "cue_idx"]).filter(~F.col("hidden"))
    doubt = F.when((F.col("status") == "changed") & (F.col("similarity") < 0.78), F.struct(F.lit("changed").alias("kind"), F.concat_ws(" / ", "source_text", "transcript_text").alias("payload"))).when(
        F.col("status") == "weak", F.struct(F.lit("weak").alias("kind"), F.format_string("%d%%", F.rint(F.col("similarity") * 100).cast("long")).alias("payload"))
    )
    tables = [
        unresolved.select("job_id", F.when(F.col("hidden"), "unresolved hidden").otherwise("unresolved").alias("kind"), F.col("cue_idx").cast("int"), F.col("text").alias("payload")),
        visible.withColumn("_d", doubt).filter("_d IS NOT NULL").select("job_id", "_d.kind", F.col("cue_idx").cast("int"), "_d.payload"),
        rejected.select("job_id", F.lit("out of order").alias("kind"), F.col("cue_idx").cast("int"), F.col("text").alias("payload")),
        moves.groupBy("job_id", "kind").agg(F.count(F.lit(1)).alias("n")).select("job_id", "kind", none.alias("cue_idx"), F.col("n").cast("string").alias("payload")),
        splits.filter("n > 0").select("job_id", "kind", none.alias("cue_idx"), F.col("n").cast("string").alias("payload")),
    ]
    return reduce(DataFrame.unionByName, tables)


def waveform_json(peaks: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, json): {"duration", "peaks"} of peaks (job_id, bin, peak) and jobs (job_id, duration)."""
    rows = peaks.groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "peak"))), lambda x: x["peak"]).alias("peaks"))
    return rows.join(jobs.select("job_id", "duration"), "job_id").select("job_id", F.to_json(F.struct("duration", "peaks")).alias("json"))
