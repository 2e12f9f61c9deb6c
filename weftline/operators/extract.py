"""What follows from a front end's raw tables: fields, implements edges, constructors, routes, imports, calls, property reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.scratch import keep

# Router methods and the HTTP method they register; suffixes tried for a relative import.
ROUTE_METHODS = {"HandleFunc": "ANY", "Handle": "ANY", "GET": "GET", "POST": "POST", "PUT": "PUT", "DELETE": "DELETE", "PATCH": "PATCH", "HEAD": "HEAD", "OPTIONS": "OPTIONS"}
IMPORT_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.vue")


def struct_fields(raw: DataFrame) -> DataFrame:
    """(repo, id, fields): wire names of a type's exported fields in order. raw: (repo, id, pos, name, tag). The JSON tag's name holds, else the field's; '-' leaves it out."""
    tag = F.regexp_extract("tag", r'(?:^|\s|`)json:"([^",]*)', 1)
    wire = raw.where(F.col("name").rlike(r"^\p{Lu}")).withColumn("wire", F.coalesce(F.nullif(tag, F.lit("")), "name")).where("wire <> '-'")
    return wire.groupBy("repo", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "wire"))), lambda x: x["wire"]).alias("fields"))


def implements(methods: DataFrame) -> DataFrame:
    """(repo, src, dst): types whose methods, by value or by pointer, hold all of a non-empty interface's. methods: (repo, owner, is_interface, generic, signature).

    An interface meets only the types that have its rarest method, and those are checked for the rest, so a method that all types have makes no pairs. Generic types are left out.
    """
    m = keep(methods.where("NOT generic").select("repo", "owner", "is_interface", "signature").distinct(), "methods")
    i = m.where("is_interface").select("repo", F.col("owner").alias("dst"), "signature")
    t = m.where("NOT is_interface").select("repo", F.col("owner").alias("src"), "signature")
    rare = i.join(t.groupBy("repo", "signature").agg(F.count(F.lit(1)).alias("types")), ["repo", "signature"], "left")
    pick = rare.groupBy("repo", "dst").agg(F.count(F.lit(1)).alias("need"), F.min(F.struct(F.coalesce("types", F.lit(0)).alias("types"), "signature")).alias("r")).where("r.types > 0")
    maybe = pick.select("repo", "dst", "need", F.col("r.signature").alias("signature")).join(t, ["repo", "signature"]).where("src <> dst").select("repo", "src", "dst", "need")
    have = maybe.join(i, ["repo", "dst"]).join(t, ["repo", "src", "signature"], "left_semi").groupBy("repo", "src", "dst", "need").agg(F.count(F.lit(1)).alias("have"))
    return have.where("have = need").select("repo", "src", "dst")


def constructors(funcs: DataFrame, types: DataFrame) -> DataFrame:
    """(repo, src, dst): functions named New... without receiver whose first result is a type of their package. funcs: (repo, id, name, package, receiver, result); types: (repo, id, name, package)."""
    f = funcs.where("startswith(name, 'New') AND receiver = ''").select("repo", F.col("id").alias("src"), "package", F.regexp_replace("result", r"^\*", "").alias("name"))
    return f.join(types.select("repo", "package", "name", F.col("id").alias("dst")), ["repo", "package", "name"]).select("repo", "src", "dst")


def routes(calls: DataFrame, funcs: DataFrame) -> DataFrame:
    """(repo, ord, method, path, handler) of router calls. calls: (repo, ord, name, args array<string>), arguments as written; funcs: (repo, id, name).

    At least two arguments, the first a string literal that begins with /; the handler is the last argument if it names a function, else ''.
    """
    method = F.create_map(*(F.lit(x) for kv in ROUTE_METHODS.items() for x in kv))[F.col("name")]
    path = F.regexp_extract(F.col("args")[0], r'^["`](/.*)["`]$', 1)
    r = calls.where(F.size("args") >= 2).select("repo", "ord", method.alias("method"), path.alias("path"), F.element_at("args", -1).alias("last")).where("method IS NOT NULL AND path <> ''")
    h = funcs.groupBy("repo", F.col("name").alias("last")).agg(F.min("id").alias("handler"))
    return r.join(h, ["repo", "last"], "left").select("repo", "ord", "method", "path", F.coalesce("handler", F.lit("")).alias("handler"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, file, spec, target): relative imports that lead to a file, by the first suffix that fits. imports: (repo, file, spec); files: (repo, file)."""
    parts = F.concat(F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1), F.split("spec", "/"))
    path = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))), lambda a: F.array_join(a, "/"))
    c = imports.where("startswith(spec, '.')").select("repo", "file", "spec", F.posexplode(F.array(*(F.concat(path, F.lit(s)) for s in IMPORT_SUFFIXES))).alias("rank", "target"))
    hit = c.join(files.select("repo", F.col("file").alias("target")).distinct(), ["repo", "target"], "left_semi")
    return hit.groupBy("repo", "file", "spec").agg(F.min_by("target", "rank").alias("target"))


def resolve_calls(sites: DataFrame, declarations: DataFrame) -> DataFrame:
    """(repo, ord, src, dst): call sites with the first indexed declaration of what they call; calls of oneself are dropped. sites: (repo, ord, src, decl); declarations: (repo, ord, decl, id)."""
    d = declarations.groupBy("repo", "decl").agg(F.min_by("id", "ord").alias("dst"))
    return sites.join(d, ["repo", "decl"]).where("src <> dst").select("repo", "ord", "src", "dst")


def property_reads(reads: DataFrame) -> DataFrame:
    """(repo, object, props, file): the properties read of each identifier in a file, callees left out. reads: (repo, file, object, prop, is_callee)."""
    return reads.where("NOT is_callee").groupBy("repo", "file", "object").agg(F.sort_array(F.collect_set("prop")).alias("props")).select("repo", "object", "props", "file")
