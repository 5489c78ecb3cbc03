"""API catalogs from library source tables.

Input: ``lib_files(lib, version, path, content)``, the ``.py``/``.pyi``
files of each library version. One Python parse per file emits T2 rows;
stub signatures are a regex in the JVM joined on the module; the source
preference is a ``coalesce``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from apidrift.session import checkpoint


# An output batch is closed when its texts reach this size.
BATCH_CHARS = 16 << 20


def _records(batches):
    import pyarrow as pa

    from apidrift.functions.pycatalog import catalog_records

    names = ["lib", "version", "kind", "api_path", "signature", "doc", "bases"]
    for b in batches:

        def batch_of(rows, idx, b=b):
            take = pa.array(idx, type=pa.int64())
            return pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take)]
                + [pa.array([r[k] for r in rows], pa.string()) for k in range(5)], names=names)

        rows, idx, size = [], [], 0
        for i, (path, text) in enumerate(zip(b.column(2), b.column(3))):
            for r in catalog_records(path.as_py(), text.as_py()):
                rows.append(r)
                idx.append(i)
                size += 100 + sum(len(v) for v in r if v is not None)
                if size >= BATCH_CHARS:
                    yield batch_of(rows, idx)
                    rows, idx, size = [], [], 0
        yield batch_of(rows, idx)


def _one(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the least of the other columns in their order (nulls last)."""
    rest = [c for c in df.columns if c not in keys]
    order = [x for c in rest for x in (F.col(c).isNull(), F.col(c))]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[x.alias(f"_{i}") for i, x in enumerate(order)])).alias("_b"))
    return best.select(*keys, *[F.col(f"_b._{2 * i + 1}").alias(c) for i, c in enumerate(rest)]).select(*df.columns)


def catalog_from_sources(lib_files: DataFrame) -> DataFrame:
    """Rows (lib, version, kind, api_path, signature, doc, bases)
    from the ``.py`` files; kind is function, method or class (class rows
    carry their bases); private names are skipped."""
    # a library's files are few and can be large: each goes to a task by its name, not by the scan's splits
    src = lib_files.where(F.col("path").endswith(".py")).select(
        "lib", "version", "path", "content").repartition("lib", "version", "path")
    return src.mapInArrow(_records, "lib string, version string, kind string, "
                          "api_path string, signature string, doc string, bases string")


def _merge_orders(lists: list[list[str]]) -> list[str]:
    """C3 merge: repeatedly the first head that no other list has further on.

    Where none is left (Python would refuse the class) the first head goes.
    """
    todo = [list(x) for x in lists if x]
    out = []
    while todo:
        later = {x for row in todo for x in row[1:]}
        head = next((row[0] for row in todo if row[0] not in later), todo[0][0])
        out.append(head)
        todo = [rest for row in todo if (rest := [x for x in row if x != head])]
    return out


def resolution_orders(records: DataFrame) -> DataFrame:
    """(lib, version, cls, mro): each class's method-resolution order.

    A round gives an order to every class whose bases have theirs: one join
    of the open classes' bases with the orders, one merge per class. Rounds
    go on until one finds nothing, so depth has no limit, and classes in a
    cycle end up with themselves only. Bases outside the given sources
    contribute nothing.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<string>")
    def merge(orders):
        import pyarrow as pa

        return pa.array([_merge_orders(x) for x in orders.to_pylist()], pa.list_(pa.string()))

    keys = ["lib", "version"]
    cls = records.where(F.col("kind") == "class").groupBy(*keys, F.col("api_path").alias("cls")).agg(
        F.min("bases").alias("bases"))
    edges = cls.select(*keys, "cls", F.posexplode(F.split(F.coalesce("bases", F.lit("")), ",")).alias("pos", "base"))
    known = cls.select(*keys, F.col("cls").alias("base"))
    edges = checkpoint(edges.join(known, [*keys, "base"]).where("base <> cls"))
    need = edges.groupBy(*keys, "cls").agg(F.count("*").alias("n"),
                                           F.sort_array(F.collect_list(F.struct("pos", "base"))).alias("bases"))
    alone = F.array(F.col("cls"))
    done = checkpoint(cls.join(need, [*keys, "cls"], "left_anti").select(*keys, "cls", alone.alias("mro")))
    open_ = checkpoint(need)
    while not open_.isEmpty():
        have = done.select(*keys, F.col("cls").alias("base"), "mro")
        ready = (edges.join(open_.select(*keys, "cls"), [*keys, "cls"], "left_semi").join(have, [*keys, "base"])
                 .groupBy(*keys, "cls").agg(F.sort_array(F.collect_list(F.struct("pos", "mro"))).alias("orders")))
        ready = ready.join(open_, [*keys, "cls"]).where(F.size("orders") == F.col("n"))
        merged = merge(F.concat(F.col("orders.mro"), F.array(F.col("bases.base"))))
        new = checkpoint(ready.select(*keys, "cls", F.concat(alone, merged).alias("mro")))
        if new.isEmpty():
            new = open_.select(*keys, "cls", alone.alias("mro"))
        done = checkpoint(done.unionByName(new))
        open_ = checkpoint(open_.join(new.select(*keys, "cls"), [*keys, "cls"], "left_anti"))
    return done


def with_inherited(records: DataFrame) -> DataFrame:
    """B2: methods of each class including those it inherits, as reflection
    lists them: the first class in method-resolution order that defines a
    name wins, and a method without a docstring takes the first one found in
    the same order. A class has one row per ancestor and method, however
    many ways lead to the ancestor.
    """
    keys = ["lib", "version"]
    records = checkpoint(records)
    order = resolution_orders(records).select(*keys, "cls", F.posexplode("mro").alias("pos", "owner"))
    own = records.where(F.col("kind") == "method").select(
        *keys,
        F.regexp_extract("api_path", r"^(.*)\.[^.]+$", 1).alias("owner"),
        F.substring_index("api_path", ".", -1).alias("name"),
        F.expr("substring(signature, length(api_path) + 1)").alias("args"), "doc")
    placed = order.join(own, [*keys, "owner"])
    w = Window.partitionBy(*keys, "cls", "name").orderBy("pos")
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = (placed.withColumn("_r", F.row_number().over(w))
            .withColumn("_doc", F.first("doc", ignorenulls=True).over(wall))
            .where("_r = 1"))
    path = F.concat(F.col("cls"), F.lit("."), F.col("name"))
    return best.select(*keys, F.lit("method").alias("kind"), path.alias("api_path"),
                       F.concat(path, F.col("args")).alias("signature"),
                       F.col("_doc").alias("doc"))


def _module(path_col):
    p = F.regexp_replace(path_col, r"\.pyi?$", "")
    p = F.regexp_replace(p, r"/__init__$", "")
    return F.regexp_replace(p, "/", ".")


def stub_signatures(lib_files: DataFrame, functions: DataFrame) -> DataFrame:
    """Signature of each function from its module's stub: the text of
    the first ``def NAME(...)`` (non-greedy up to the first ``)``) that a
    colon follows. A stub is read once for all its names, which are then
    joined with the functions, so its text goes to no function's row."""
    stubs = lib_files.where(F.col("path").endswith(".pyi")).select(
        F.monotonically_increasing_id().alias("_stub"), "lib", "version", _module(F.col("path")).alias("module"),
        F.expr("substring(content, 1, length(content) - length(substring_index(content, ':', -1)) - 1)").alias("head"))
    # the look ahead leaves the arguments to be searched for further names
    pat = F.lit(r"def ([^ (]+)\((?=([^)]*)\))")
    defs = stubs.select("_stub", "lib", "version", "module", F.posexplode(F.arrays_zip(
        F.regexp_extract_all("head", pat, 1).alias("name"), F.regexp_extract_all("head", pat, 2).alias("args"))).alias("pos", "d"))
    first = defs.groupBy("_stub", "lib", "version", "module", F.col("d.name").alias("name")).agg(
        F.min_by("d.args", "pos").alias("args"))
    f = functions.withColumn("name", F.substring_index("api_path", ".", -1)).withColumn(
        "module", F.expr("substring(api_path, 1, length(api_path) - length(name) - 1)"))
    return f.join(first, ["lib", "version", "module", "name"]).select(
        "lib", "version", "api_path", F.concat(F.col("api_path"), F.lit("("), "args", F.lit(")")).alias("stub_signature"))


def prefer_sources(functions: DataFrame, stubs: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """The signature a supplied catalog gives as text (lib, version,
    api_path, signature) first, then the stub's, then the source's. An API
    without any is left out; of several supplied ones the least counts."""
    keys = ["lib", "version", "api_path"]
    j = functions.join(stubs, keys, "left")
    first = []
    if supplied is not None:
        j = j.join(supplied.select(*keys, F.col("signature").alias("supplied_signature"))
                   .transform(_one, keys), keys, "left")
        first = ["supplied_signature"]
    return j.withColumn("signature", F.coalesce(*first, "stub_signature", "signature")).where(
        "signature IS NOT NULL").drop("stub_signature", "supplied_signature")


def _parent(path):
    return F.regexp_replace(path, r"\.[^.]*$", "")


def exported_paths(records: DataFrame) -> DataFrame:
    """(lib, version, alias_path, target): public paths that stand for a class.

    ``from m import *`` takes the public names of ``m``, those it imports
    itself included; a name that stands for another imported name is followed
    to the class. Both go on until a round changes nothing.
    """
    keys = ["lib", "version"]
    classes = records.where(F.col("kind") == "class").select(
        *keys, F.col("api_path").alias("path"), F.col("api_path").alias("target"))
    names = records.where(F.col("kind") == "reexport").select(
        *keys, F.col("api_path").alias("path"), F.col("bases").alias("target"))
    stars = checkpoint(records.where(F.col("kind") == "star").select(
        *keys, F.col("api_path").alias("to"), F.col("bases").alias("module")).distinct())
    found = checkpoint(_one(classes.unionByName(names), [*keys, "path"]))
    new = found
    while True:
        public = new.withColumn("module", _parent(F.col("path"))).withColumn(
            "name", F.substring_index("path", ".", -1)).where(~F.col("name").startswith("_"))
        taken = public.join(stars, [*keys, "module"]).select(
            *keys, F.concat("to", F.lit("."), "name").alias("path"), F.col("path").alias("target"))
        new = checkpoint(_one(taken, [*keys, "path"]).join(found, [*keys, "path"], "left_anti"))
        if new.isEmpty():
            break
        found = checkpoint(found.unionByName(new))
    links = found.where("path <> target")
    while True:
        # follow two steps at once; a path that leads round in a circle ends
        # where it began and is no class
        nxt = links.select(*keys, F.col("path").alias("target"), F.col("target").alias("further"))
        step = checkpoint(links.join(nxt, [*keys, "target"], "left").where(
            "further is null or further <> path").withColumn("moved", F.col("further").isNotNull()).withColumn(
            "target", F.coalesce("further", "target")).drop("further"))
        links = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return links.withColumnRenamed("path", "alias_path")


def with_reexports(records: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods of a class also under every public path that imports the
    class (reflection walks modules and lists the class where it finds it).
    One equi-join of exported paths with the methods' owner class."""
    keys = ["lib", "version"]
    rx = exported_paths(records)
    m = methods.select(
        *keys, "kind", "signature", "doc", "api_path",
        F.regexp_extract("api_path", r"^(.*)\.[^.]+$", 1).alias("target"),
        F.substring_index("api_path", ".", -1).alias("name"),
        F.expr("substring(signature, length(api_path) + 1)").alias("args")).drop("api_path")
    path = F.concat("alias_path", F.lit("."), "name")
    moved = m.join(rx, [*keys, "target"]).select(
        *keys, "kind", path.alias("api_path"), F.concat(path, "args").alias("signature"), "doc")
    return _one(methods.unionByName(moved), [*keys, "api_path"])
