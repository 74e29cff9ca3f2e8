"""Scans and sinks.

Paths are Hadoop paths; existence checks go through the Hadoop FileSystem
of the session, so the same code runs on local disk, HDFS or object
stores.  Python runs only where a format has no Spark reader (Stata,
encoding sniffing), inside ``mapInPandas`` tasks that open files through
``pyarrow.fs`` and read them in blocks.
"""

from __future__ import annotations

import functools
import hashlib
import io as _io
import os
import uuid
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.operators.joins import bounded_broadcast
from quorum.session import checkpoint_dir


# ------------------------------------------------------------------ paths

def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex[:10]}")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def store(uri: str):
    """The ``pyarrow.fs`` file system of a path or URI, and the path in it:
    how tasks reach files in shared storage."""
    import pyarrow.fs
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_file(uri: str, content: bytes) -> None:
    """Write a small file from a task, with its folder."""
    fs, path = store(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(content)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the scratch folder and read back: for a result
    that several branches use, with nothing held in executors' memory."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path) of the files; their content is not read."""
    paths = spark.read.format("binaryFile").load(pattern).select("path")
    return paths.repartition(max(1, paths.count()))  # a file per task


def publish_path(spark: SparkSession, path: str) -> str:
    """The path itself, or ``<stem>_<yyyyMMddHHmmss><ext>`` when it exists."""
    if not path_exists(spark, path):
        return path
    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMddHHmmss")).first()[0]
    stem, ext = os.path.splitext(path)
    return f"{stem}_{stamp}{ext}"


# ------------------------------------------------------------------ S1: wave files

def write_waves(wide: DataFrame, root: str) -> list[int]:
    """One folder per wave (``wave=<n>``), in one write; returns the waves.

    Files hold the plain column names; ``scan_waves`` gives every column but
    QKEY the suffix ``_W<n>`` of its wave."""
    wide.write.mode("overwrite").partitionBy("wave").parquet(root)
    fs, p = _fs(wide.sparkSession, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)]  # one folder per wave: metadata
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("wave="))


def _suffixed(column: str, wave: int, key: str) -> str:
    return column if column == key or column.endswith(f"_W{wave}") else f"{column}_W{wave}"


def wave_layouts(spark: SparkSession, root: str, waves: Sequence[int], key: str = "QKEY") -> list[tuple[list[int], dict[str, str]]]:
    """The waves grouped by their files' columns: (waves, question -> column),
    from the schemas alone.  A question is named without its wave's suffix.  Fails
    if a wave is absent."""
    out: dict[tuple, tuple[list[int], dict[str, str]]] = {}
    for w in waves:
        path = os.path.join(root, f"wave={w}")
        if not path_exists(spark, path):
            raise FileNotFoundError(path)
        names = {_suffixed(c, w, key).removesuffix(f"_W{w}"): c for c in spark.read.parquet(path).columns}
        out.setdefault(tuple(sorted(names.items())), ([], names))[0].append(int(w))
    return list(out.values())


def _scan_layouts(spark: SparkSession, root: str, layouts, select: Callable) -> DataFrame:
    """One scan per layout, the same columns from each, put together."""
    frames = []
    for waves, names in layouts:
        df = spark.read.option("basePath", root).parquet(*[os.path.join(root, f"wave={w}") for w in waves])
        frames.append(select(df.withColumn("wave", F.col("wave").cast("int")), waves, names))
    return functools.reduce(DataFrame.unionByName, frames)


def scan_wave_answers(spark: SparkSession, root: str, waves: Sequence[int], key: str = "QKEY", weight: str = "WEIGHT",
                      other: Sequence[str] = ()) -> DataFrame:
    """S1, long: ``(human_id, wave, qkey, var, code, weight)``, every wave unpivoted from
    its own columns before the union, so that the plan grows with the sum of the
    waves' questions and rows never hold another wave's.  Waves with the
    same columns are one scan.  ``other`` columns are no questions."""
    def select(df, waves, names):
        asked = [q for q in names if q not in (key, weight, *other)]
        qa = F.explode(F.array(*[F.struct(F.lit(q).alias("var"), F.col(names[q]).cast("double").alias("code")) for q in asked])).alias("qa")
        own = F.col(names[weight]).cast("double") if weight in names else F.lit(None).cast("double")
        return df.select(F.col(key).alias("human_id"), "wave", own.alias("weight"), qa).select(
            "human_id", "wave", F.concat("qa.var", F.lit("_W"), F.col("wave").cast("string")).alias("qkey"), "qa.var", "qa.code", "weight")
    return _scan_layouts(spark, root, wave_layouts(spark, root, waves, key), select)


def scan_wave_weights(spark: SparkSession, root: str, waves: Sequence[int], key: str = "QKEY") -> DataFrame:
    """``(key, wave, weight)``: each wave's weight column is found by its name
    pattern ``weight_*_w<wave>``, in its own layout."""
    from quorum.operators.responses import weight_column
    layouts = []
    for own, names in wave_layouts(spark, root, waves, key):
        by_column: dict[str, list[int]] = {}
        for w in own:
            back = {_suffixed(c, w, key): c for c in names.values()}
            by_column.setdefault(back[weight_column(list(back), w)], []).append(w)
        layouts += [(ws, {"weight": c}) for c, ws in by_column.items()]
    return _scan_layouts(spark, root, layouts, lambda df, _, names: df.select(key, "wave", F.col(names["weight"]).cast("double").alias("weight")))


def resolved_columns(spark: SparkSession, root: str, waves: Sequence[int], candidates: Mapping[str, Sequence[str]],
                     key: str = "QKEY") -> list[tuple[int, str, str]]:
    """(wave, attribute, column): the first of an attribute's candidate
    columns that the wave's files have; an error if there is none."""
    from quorum.operators.groups import choose_column
    return [(w, attribute, names[choose_column(list(names), list(columns))])
            for own, names in wave_layouts(spark, root, waves, key) for w in own for attribute, columns in candidates.items()]


def scan_wave_attributes(spark: SparkSession, root: str, waves: Sequence[int], candidates: Mapping[str, Sequence[str]],
                         key: str = "QKEY") -> DataFrame:
    """``(key, wave, attribute, var, code)``: every person's codes, from the
    column that their wave has for the attribute."""
    from quorum.operators.groups import choose_column

    def select(df, _, names):
        own = {a: choose_column(list(names), list(columns)) for a, columns in candidates.items()}
        code = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(v).alias("var"), F.col(names[v]).cast("string").alias("code"))
                                   for a, v in own.items()])).alias("x")
        return df.select(key, "wave", code).select(key, "wave", "x.*")
    return _scan_layouts(spark, root, wave_layouts(spark, root, waves, key), select)


def scan_waves(spark: SparkSession, root: str, waves: Sequence[int]) -> DataFrame:
    """Read the listed waves (fail if one is absent) and union them by
    name with missing columns as NULL; ``wave`` is a column."""
    frames = []
    for w in waves:
        p = os.path.join(root, f"wave={w}")
        if not path_exists(spark, p):
            raise FileNotFoundError(p)
        part = spark.read.parquet(p)
        frames.append(part.select(*[F.col(c).alias(c if c == "QKEY" or c.endswith(f"_W{w}") else f"{c}_W{w}") for c in part.columns],
                                  F.lit(int(w)).alias("wave")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ S2/S3: Stata

def write_stata(df: DataFrame, root: str, by: str, value_labels: dict | None = None,
                variable_labels: dict | None = None) -> DataFrame:
    """Stata files under ``<root>/<by>=<value>/``: every task writes the
    rows it holds, sorted by key, in files of up to ``STATA_ROWS`` rows (fewer of a wide
    table), so no key (however large) is gathered into one task, and files
    are as many as the rows ask for.  Returns (by, path) per file."""
    vl = value_labels or {}
    varl = variable_labels or {}
    most = max(1, min(STATA_ROWS, STATA_CELLS // len(df.columns)))

    def file(key, parts):
        import uuid as _uuid
        path = f"{root}/{by}={key}/part-{_uuid.uuid4().hex[:12]}.dta"
        made = _io.BytesIO()
        data = pd.concat(parts, ignore_index=True).drop(columns=[by])
        labels = {c: {int(k): v for k, v in m.items()} for c, m in vl.items() if c in data.columns}
        for c in labels:
            data[c] = data[c].astype("float64")
        data.to_stata(made, write_index=False, value_labels=labels or None,
                      variable_labels={c: v for c, v in varl.items() if c in data.columns} or None)
        write_file(path, made.getvalue())
        return pd.DataFrame([(key, path)], columns=[by, "path"])

    def write(batches):
        own, parts, held = None, [], 0
        for pdf in batches:
            for key, part in pdf.groupby(by, sort=False):
                if held and key != own:
                    yield file(own, parts)
                    parts, held = [], 0
                own, at = key, 0
                while at < len(part):
                    parts.append(part.iloc[at:at + most - held])
                    at, held = at + len(parts[-1]), held + len(parts[-1])
                    if held == most:
                        yield file(own, parts)
                        parts, held = [], 0
        if held:
            yield file(own, parts)

    schema = T.StructType([df.schema[by], T.StructField("path", T.StringType())])
    return df.sortWithinPartitions(by).mapInPandas(write, schema)


def scan_stata(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Distributed Stata read — one task per file, pandas' StataReader in
    the task, ``STATA_ROWS`` rows at a time; NaN answers become NULL."""
    out_schema = T._parse_datatype_string(schema)

    def read(batches):
        for b in batches:
            for path in b["path"]:
                fs, inner = store(path)
                with fs.open_input_file(inner) as f, pd.io.stata.StataReader(
                        f, convert_categoricals=False, chunksize=STATA_ROWS) as r:
                    for pdf in r:
                        pdf["source_file"] = path
                        yield pdf[[x.name for x in out_schema.fields]]  # a missing value of a column is NULL in Arrow

    return _listing(spark, pattern).mapInPandas(read, out_schema)


def scan_codebook(spark: SparkSession, pattern: str) -> DataFrame:
    """S3: value labels ``(var, pos, code, label)`` and variable labels of
    Stata files.  Of the rows only the first is read, which lets the reader
    find the labels behind the data section."""

    def read(batches):
        for b in batches:
            for path in b["path"]:
                fs, inner = store(path)
                with fs.open_input_file(inner) as f, pd.io.stata.StataReader(f) as r:
                    r.read(nrows=1, convert_categoricals=False)
                    value_labels = r.value_labels()
                    names = getattr(r, "_varlist", None) or list(r.variable_labels())
                    sets = getattr(r, "_lbllist", None) or names  # pandas names a label set after its column
                    lbl_names = {v: (s or v) for v, s in zip(names, sets)}
                    var_labels = r.variable_labels()
                rows = []
                for var, lname in lbl_names.items():
                    for pos, (code, label) in enumerate(value_labels.get(lname, {}).items(), start=1):
                        rows.append((path, var, pos, float(code), str(label), var_labels.get(var, "")))
                yield pd.DataFrame(rows, columns=["source_file", "var", "pos", "code", "label", "var_label"])

    return _listing(spark, pattern).mapInPandas(read, "source_file string, var string, pos int, code double, label string, "
                                   "var_label string")


# ------------------------------------------------------------------ S4: encodings

STATA_ROWS = 50_000   # rows of a Stata file held at a time
STATA_CELLS = 2_000_000  # values of a Stata file that is written
SNIFF_BYTES = 1 << 20

# Encodings in the order they are tried.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "cp936")


def detect_encodings(spark: SparkSession, pattern: str) -> DataFrame:
    """Per file the first encoding in utf-8 → utf-8-sig → gbk → cp936
    that decodes it strictly (a BOM picks utf-8-sig).  All encodings are
    tried in one pass over the file, in blocks."""

    def sniff(batches):
        import codecs
        for b in batches:
            out = []
            for path in b["path"]:
                fs, inner = store(path)
                left = {e: codecs.getincrementaldecoder(e)() for e in ENCODINGS}
                with fs.open_input_stream(inner) as f:
                    first = block = f.read(SNIFF_BYTES)
                    while left:
                        for e in list(left):
                            try:
                                left[e].decode(block, final=not block)
                            except UnicodeDecodeError:
                                del left[e]
                        if not block:
                            break
                        block = f.read(SNIFF_BYTES)
                if first.startswith(codecs.BOM_UTF8):
                    left.pop("utf-8", None)
                out.append(next((e for e in ENCODINGS if e in left), None))
            yield pd.DataFrame({"path": b["path"], "encoding": out})

    return _listing(spark, pattern).mapInPandas(sniff, "path string, encoding string")


def read_csv_auto(spark: SparkSession, pattern: str, **options) -> DataFrame:
    """Read CSV files each with its detected encoding — one Spark read
    per encoding over all files that have it (``utf-8-sig`` is UTF-8 with
    the BOM stripped from the first header)."""
    enc = detect_encodings(spark, pattern).collect()  # one row per file: a listing, not data
    by_enc: dict[str, list[str]] = {}
    for r in enc:
        if r["encoding"] is None:
            raise ValueError(f"cannot decode {r['path']}")
        e = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "gbk": "GBK", "cp936": "GBK"}[r["encoding"]]
        by_enc.setdefault(e, []).append(r["path"])
    frames = []
    for e, paths in sorted(by_enc.items()):
        if e == "GBK":  # Spark 4 accepts non-Unicode charsets only with the legacy switch
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        df = spark.read.options(header=True, encoding=e, **options).csv(paths)
        df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
        frames.append(df.withColumn("source_file", F.input_file_name()))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ S5, S10, S13

def read_csv_dropna(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header, rows with any NULL dropped and a dense ``row_idx``
    in file order given to the rest.  A ``schema`` saves the pass that infers
    the types."""
    from quorum.operators.positions import scan
    r = spark.read.option("header", True)
    df = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    return scan(in_file_order(df).na.drop("any", subset=df.columns), FILE_ORDER).rows.drop(*FILE_ORDER)


FILE_ORDER = ["_file", "_block", "_at"]


def in_file_order(files: DataFrame) -> DataFrame:
    """A scan of files with FILE_ORDER: the file, where its split begins and
    the row's place there, however splits are dealt to tasks."""
    return files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_at"))


def read_paired_eval_csv(spark: SparkSession, baseline: str, finetuned: str, metrics: Sequence[str],
                         schema: str | None = None) -> DataFrame:
    """J9 on files without an index: row n of one metric CSV with row n of the
    other (error when their counts differ); ``row_idx`` is the place in the file."""
    from quorum.operators.compare import paired_by_position
    sides = [in_file_order(read_eval_csv(spark, p, metrics, schema)) for p in (baseline, finetuned)]
    return paired_by_position(*sides, FILE_ORDER, "row_idx", metrics)


def read_prompts_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Prompt CSV with quoted multi-line cells."""
    r = spark.read.options(header=True, multiLine=True, escape='"', quote='"')
    return (r.schema(schema) if schema else r).csv(path)


def write_prompts_csv(df: DataFrame, path: str) -> None:
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    out = df.select(*[F.to_json(c).alias(c) if c in arrays else F.col(c) for c in df.columns])
    out.write.mode("overwrite").options(header=True, escape='"', quote='"').csv(path)


def read_eval_csv(spark: SparkSession, path: str, required: Sequence[str] = ("kl", "wd", "loss_used"),
                  schema: str | None = None) -> DataFrame:
    """Metric CSV; error when a required column is missing.  A ``schema``
    saves the pass that infers the types."""
    r = spark.read.option("header", True)
    df = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    return df


# ------------------------------------------------------------------ S6–S8, S14: JSON

def read_json_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array of records (multi-line file)."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_json_dict(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """A JSON object ``{key: value}`` -> one row per key (file read whole)."""
    t = spark.read.text(path, wholetext=True)
    m = F.from_json("value", f"map<string,{value_type}>")
    return t.select(F.explode(m).alias("key", "value"))


def read_config_groups(spark: SparkSession, path: str) -> DataFrame:
    """Nested config ``subpopulations[{attribute, column, value_map}]`` ->
    long ``(attribute, column, grp, code)``."""
    schema = ("subpopulations array<struct<attribute:string,column:string,value_map:map<string,array<string>>>>, "
              "global_invalid_codes array<double>, global_refusal_codes array<double>")
    c = spark.read.option("multiLine", True).schema(schema).json(path)
    s = c.select(F.explode("subpopulations").alias("s"))
    g = s.select("s.attribute", "s.column", F.explode("s.value_map").alias("grp", "codes"))
    return g.select("attribute", "column", "grp", F.explode("codes").alias("code"))


# The arrays of a training-metric file.
TRAIN_METRIC_KEYS = ("train_step_loss", "train_epoch_loss", "train_step_perplexity", "train_epoch_perplexity",
                     "val_step_loss", "val_epoch_loss", "val_step_perplexity", "val_epoch_perplexity")


def _train_metric_files(spark: SparkSession, pattern: str) -> DataFrame:
    fields = ", ".join(f"{k} array<double>" for k in TRAIN_METRIC_KEYS)
    return (spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
                 .option("columnNameOfCorruptRecord", "_corrupt_record")
                 .schema(f"{fields}, _corrupt_record string").json(pattern)
                 .withColumn("source_file", F.input_file_name()))


def unreadable_train_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """(source_file, record) of every file that is not such JSON."""
    return (_train_metric_files(spark, pattern).where(F.col("_corrupt_record").isNotNull() & F.coalesce(*TRAIN_METRIC_KEYS).isNull())
            .select("source_file", F.col("_corrupt_record").alias("record")))


def read_train_metric_rows(spark: SparkSession, path: str, keys: str = "run long, part long") -> tuple[DataFrame, DataFrame]:
    """S14, many runs in a file: lines of JSON with ``keys`` and the arrays ->
    (a row per key, series, index, value; the lines that are not such JSON)."""
    fields = ", ".join(f"{k} array<double>" for k in TRAIN_METRIC_KEYS)
    raw = (spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
           .schema(f"{keys}, {fields}, _corrupt_record string").json(path))
    names = [k.split()[0] for k in keys.split(", ")]
    series = F.explode(F.array(*[F.struct(F.lit(k).alias("series"), F.col(k).alias("v")) for k in TRAIN_METRIC_KEYS])).alias("s")
    good = raw.where(F.col("_corrupt_record").isNull()).select(*names, series)
    bad = raw.where(F.col("_corrupt_record").isNotNull() & F.coalesce(*TRAIN_METRIC_KEYS).isNull()).select(F.col("_corrupt_record").alias("record"))
    return good.select(*names, "s.series", F.posexplode("s.v").alias("idx", "value")), bad


def read_train_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """Training-metric JSON files (8 parallel arrays) -> one row per
    (file, series, index, value).  ``unreadable_train_metrics`` lists the files
    that this leaves out."""
    raw = _train_metric_files(spark, pattern)
    series = F.explode(F.array(*[F.struct(F.lit(k).alias("series"), F.col(k).alias("v"))
                                 for k in TRAIN_METRIC_KEYS])).alias("s")
    ok = raw.where(F.col("_corrupt_record").isNull()).select("source_file", series)
    return ok.select("source_file", "s.series", F.posexplode("s.v").alias("idx", "value"))


# ------------------------------------------------------------------ S11 / K7: cache

def cached(spark: SparkSession, cache_root: str, input_name: str, tokenizer_name: str,
           build: Callable[[], DataFrame]) -> DataFrame:
    """Parquet cache keyed by (full input path, tokenizer); reuse when
    the write committed (``_SUCCESS`` present), else build and write."""
    whole = hashlib.sha256(f"{input_name}\0{tokenizer_name}".encode()).hexdigest()[:16]
    key = f"{os.path.basename(input_name)}__{tokenizer_name.replace('/', '_')}__{whole}"
    path = os.path.join(cache_root, key)
    if not path_exists(spark, os.path.join(path, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ sinks

def write_distribution(dist: DataFrame, path: str, csv: bool = False) -> DataFrame:
    """K1: Parquet (arrays kept) or CSV (arrays as JSON text); an empty
    result is an error, as in the reference."""
    if dist.limit(1).count() == 0:
        raise ValueError("no rows produced")
    if csv:
        write_prompts_csv(dist, path)
    else:
        dist.write.mode("overwrite").parquet(path)
    return dist.sparkSession.read.parquet(path) if not csv else read_prompts_csv(dist.sparkSession, path)


def write_partitioned(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """K2/K8/K9: one write, partitioned by ``cols``."""
    df.write.mode("overwrite").partitionBy(*cols).parquet(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    """K4: one JSON object per row."""
    df.write.mode("overwrite").json(path)


# ------------------------------------------------------------------ prompt sets, scored sets

# The parts of a prompt set's path.
PROMPT_SET = ("dataset", "attribute", "grp", "steering_type", "split")


def write_prompt_sets(prompts: DataFrame, path: str, dataset: str) -> None:
    """K2: the prompts of a data set below ``dataset=/attribute=/grp=/steering_type=/split=``."""
    replace_sets(prompts.withColumn("dataset", F.lit(dataset)), path, PROMPT_SET)


def replace_sets(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """K2/K8: the sets (values of ``keys``) that ``df`` holds are written, those
    that are there already replaced, and no other set's files touched."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def select_sets(sets: DataFrame, work: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the sets that a work list names by ``keys``.  The list
    is joined to the partition columns, which prunes folders at run time, before
    any file of another set is opened."""
    listed = work.select(*keys).where(F.length(F.concat_ws("", *keys)) > 0).distinct()
    return sets.join(bounded_broadcast(listed), list(keys), "left_semi")
