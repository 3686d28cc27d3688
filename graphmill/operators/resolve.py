"""Binding name-shaped references to nodes.

Nodes become one table of targets, with a row for each way of naming a node;
references become probes of that table, each with the rank of its way.  One join
and one aggregate then give every name its best target, however many ways there
are.  Distinct names are resolved, not references, so a name that millions of
references use is looked up once, and the rows of hot names are spread when they
meet the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import directory_of, is_fixture, is_test_file
from ..session import written
from .orphans import bare_name
from .skew import keyed_join

#: Kinds that no call or name of code refers to.
NOT_CODE = ("Setting", "Section", "Document", "Resource", "Output", "Local", "Provider", "Block", "DataSource")
EDGE = ["project_id", "from_id", "to_id", "kind"]
#: Packages of Go's standard library by the name they are used under; a call on them is no call of a method of the project.
STANDARD = (
    "ast atomic base64 big binary bits bufio build bytes cgo cmplx color constant container context crypto csv doc draw driver ecdsa ed25519 elliptic encoding errors exec expvar filepath flate fmt format gif gzip hash heap hex html http image "
    "importer io ioutil ip jpeg jsonrpc list log mail math md5 mime multipart net os parser path pem plugin png pprof printer rand reflect regexp ring rpc rsa runtime scanner sha1 sha256 signal slog smtp sort sql strconv strings subtle sync syscall "
    "tabwriter tar tcp template text time tls token trace types udp unicode unsafe url user utf16 utf8 x509 xml zip"
).split()
#: Methods of Go's standard interfaces and types, which tell nothing about their receiver.
COMMON_METHODS = (
    "String Error GoString Read Write Close Seek ReadAt WriteAt ReadFrom WriteTo ReadByte WriteByte ReadString WriteString ReadRune WriteRune UnreadByte UnreadRune Lock Unlock RLock RUnlock TryLock Len Less Swap ServeHTTP "
    "MarshalJSON UnmarshalJSON MarshalText UnmarshalText MarshalBinary UnmarshalBinary MarshalYAML UnmarshalYAML Format Scan Now Add Sub Before After Equal Deadline Done Err Value Is As Unwrap Run"
).split()
#: Directories that Python packages may lie in without being part of their names.
ROOTS = ("src",)
#: Files that declare variables of playbooks.
VARIABLE_FILES = r"(?:(?:^|/)(?:group_vars|host_vars|vars)/|/defaults/).*\.ya?ml$"
_SEP = "\u0001"
_COLUMNS = ["file_path", "name", "qualified_name", "kind", "language", "parent"]


def nodes_in_force(symbols: DataFrame, *more: str) -> DataFrame:
    """The last version of each symbol that isn't deleted, with the columns that resolving needs and more.

    Of versions with equal indexed_at a deletion wins, then the largest values.
    """
    cols = [*_COLUMNS, *more]
    last = F.max(F.struct("indexed_at", F.col("deleted_at").isNotNull().alias("gone"), *cols)).alias("v")
    return symbols.groupBy("project_id", "id").agg(last).where(~F.col("v.gone")).select("project_id", "id", *(f"v.{c}" for c in cols))


def pending(edges: DataFrame, *kinds: str) -> DataFrame:
    """References of some kinds, once per (project, file, kind, from_qn, to_name), names without decoration.

    Of equal ones the surest confidence and the largest types count.
    """
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    types = [F.col(c) if c in edges.columns else F.lit(None).cast("string").alias(c) for c in ("receiver_type", "base_type")]
    e = e.select("project_id", "from_file", "kind", bare_name(F.col("from_qn")).alias("from_qn"), bare_name(F.col("to_name")).alias("to_name"), "confidence", *types)
    return e.where("to_name is not null").groupBy("project_id", "from_file", "kind", "from_qn", "to_name").agg(*(F.max(c).alias(c) for c in ("confidence", "receiver_type", "base_type")))


def _ways() -> dict[str, tuple[Column, Column, Column]]:
    """By way of naming: which nodes have the name, the name, and what is best besides the least id."""
    code, method = ~F.col("kind").isin(*NOT_CODE), F.col("kind") == "Method"
    value = F.when(F.col("kind") == "Variable", 0).when(F.col("kind") == "Function", 1).when(method, 2)
    zero = F.lit(0)
    return {
        "qn": (code, F.col("qualified_name"), zero),
        "any": (F.lit(True), F.col("qualified_name"), zero),
        "file": (F.lit(True), F.concat_ws(_SEP, "file_path", "qualified_name"), zero),
        "name": (code & ~method, F.col("name"), zero),
        "method": (method, F.col("name"), zero),
        "value": (value.isNotNull(), F.concat_ws(_SEP, "language", directory_of(F.col("file_path")), "name"), value),
        "value anywhere": (value.isNotNull(), F.col("name"), value),
        "setting": ((F.col("kind") == "Setting") & F.col("file_path").rlike(VARIABLE_FILES), F.col("name"), zero),
        "module": (F.col("kind") == "Module", F.col("qualified_name"), zero),
        "in file": (F.lit(True), F.col("file_path"), zero),
    }


def targets(nodes: DataFrame, *ways: str) -> DataFrame:
    """(project_id, way, name, v, alone): the best node of each name by each way, and whether it is the only one.

    Nodes outside fixtures come first, then the way's order, then the least id.
    A way "member" names the members of classes as class.member.
    """
    table = _ways()
    fixture = F.coalesce(is_fixture(F.col("file_path")), F.lit(False)).cast("int")
    outside = lambda w: fixture if w in ("name", "method", "value", "value anywhere") else F.lit(0)
    rows = F.array(*(F.when(table[w][0], F.struct(F.lit(w).alias("way"), table[w][1].alias("name"), outside(w).alias("f"), table[w][2].cast("int").alias("r"))) for w in ways if w != "member"))
    every = nodes.select("project_id", "id", "language", "kind", "file_path", F.explode(rows).alias("t")).where("t is not null and t.name is not null").select("project_id", "t.*", "id", "language", "kind")
    if "member" in ways:
        classes = nodes.where(F.col("kind").isin("Class", "Interface")).groupBy("project_id", "name").agg(F.min(F.struct("id", "qualified_name")).alias("c")).select("project_id", F.col("c.qualified_name").alias("owner"), F.col("name").alias("class"))
        own = nodes.where(~F.col("kind").isin(*NOT_CODE)).select("project_id", F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("owner"), F.substring_index("qualified_name", ".", -1).alias("last"), "id", "language", "kind")
        members = own.join(classes, ["project_id", "owner"]).select("project_id", F.lit("member").alias("way"), F.concat_ws(".", "class", "last").alias("name"), F.lit(0).alias("f"), F.lit(0).alias("r"), "id", "language", "kind")
        every = every.unionByName(members)
    best = F.min(F.struct("f", "r", "id", "language", "kind")).alias("v")
    outside_n = F.count_if(F.col("f") == 0)
    return every.groupBy("project_id", "way", "name").agg(best, F.when(outside_n > 0, outside_n == 1).otherwise(F.count(F.lit(1)) == 1).alias("alone"))


def resolve(keys: DataFrame, on: list[str], probes: list[tuple[str, str, Column]], table: DataFrame) -> DataFrame:
    """keys and their number n with to_id, to_language, to_kind and label of the first probe (label, way, name) that finds a target."""
    tries = F.array(*(F.struct(F.lit(k).alias("__rank"), F.lit(label).alias("__label"), F.lit(way).alias("__way"), name.alias("__name")) for k, (label, way, name) in enumerate(probes)))
    asked = keys.select(*on, "n", F.explode(tries).alias("__t")).where("__t.__name is not null").select(*on, "n", "__t.*")
    named = table.select("project_id", F.col("way").alias("__way"), F.col("name").alias("__name"), "v", "alone")
    hit = asked.join(named, ["project_id", "__way", "__name"]).where((F.col("__way") != "method") | F.col("alone"))
    best = hit.groupBy(*on).agg(F.max("n").alias("n"), F.min(F.struct("__rank", "__label", "v")).alias("b"))
    return best.select(*on, "n", F.col("b.v.id").alias("to_id"), F.col("b.v.language").alias("to_language"), F.col("b.v.kind").alias("to_kind"), F.col("b.__label").alias("label"))


def _undotted(c: Column) -> Column:
    return F.when(~F.contains(c, F.lit(".")), c)


def with_sources(refs: DataFrame, table: DataFrame, probes: list[tuple[str, str, Column]], total: int) -> DataFrame:
    """refs with from_id and from_language: the node that each comes from; others are left out."""
    on = ["project_id", "from_file", "from_qn"]
    keys = refs.where("from_qn is not null").groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    found = resolve(keys, on, probes, table).select(*on, "n", F.col("to_id").alias("from_id"), F.col("to_language").alias("from_language"))
    return keyed_join(refs, written(found), on, ("from_id", "from_language"), total=total)


def _from(last: str) -> list[tuple[str, str, Column]]:
    """Ways to find a source: its name in the same file, in the project, and its bare name."""
    qn = F.col("from_qn")
    return [("1", "file", F.concat_ws(_SEP, "from_file", "from_qn")), ("2", "any", qn), ("3", last, _undotted(qn))]


def absolute_name(name: Column, file: Column) -> Column:
    """A Python name with leading dots as seen from its file; null where it leaves the project."""
    level = F.length(F.regexp_extract(name, r"^\.+", 0))
    folders = F.slice(F.split(file, "/"), 1, F.greatest(F.size(F.split(file, "/")) - 1, F.lit(0)))
    keep = F.size(folders) - level + 1
    whole = F.concat_ws(".", F.nullif(F.array_join(F.slice(folders, 1, F.greatest(keep, F.lit(0))), "."), F.lit("")), F.nullif(F.substring(name, level + 1, F.length(name)), F.lit("")))
    return F.when(level == 0, name).when(keep >= 0, F.nullif(whole, F.lit("")))


def _extension(file: Column) -> Column:
    return F.coalesce(F.lower(F.substring_index(file, ".", -1)), F.lit(""))


def _python(file: Column) -> Column:
    return _extension(file).isin("py", "pyw", "pyi")


def _absolute(name: Column, file: Column) -> Column:
    """absolute_name of the names in Python files that need it, other names as they are."""
    return F.when(F.startswith(name, F.lit(".")) & _python(file), absolute_name(name, file)).otherwise(name)


def _rooted(name: Column, python: Column) -> list[tuple[str, str, Column]]:
    return [("1 qualified name", "qn", F.when(python & ~F.startswith(name, F.lit(f"{r}.")), F.concat(F.lit(f"{r}."), name))) for r in ROOTS]


def finish(edges: DataFrame, source: str = "resolve_pass") -> DataFrame:
    """Edges once per ends and kind, without those to themselves; of equal ones the surest and first way."""
    return edges.where("from_id <> to_id").groupBy(*EDGE).agg(F.max("confidence").alias("confidence"), F.min("label").alias("way")).withColumn("source", F.lit(source))


def resolve_calls(pending_edges: DataFrame, nodes: DataFrame, struct_fields: DataFrame | None = None) -> DataFrame:
    """CALLS edges: by qualified name, bare name, the receiver's type, a class's member, or a method's name that is the only one.

    A receiver's type is looked for in the module of the calling file and in the
    first part of the caller's name; ``struct_fields`` (project_id, struct_qn,
    field_name, field_type) leads from a field to its type.  Members of classes
    count in JavaScript and TypeScript.  Methods by name alone aren't taken where
    the receiver is a standard package or the method one of every type.
    References to oneself are dropped; of equal edges the surest is kept.
    """
    total = pending_edges.count()  # from the files' footers
    refs = pending(pending_edges, "CALLS")
    typed = F.col("receiver_type").isNotNull() & F.contains(F.col("to_name"), F.lit("."))
    module = F.regexp_replace(F.replace("from_file", F.lit("/"), F.lit(".")), r"\.\w+$", "")
    script = _extension(F.col("from_file")).isin("js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx")
    python = _python(F.col("from_file"))
    # what a target depends on besides its name: nothing, but for typed receivers and Python
    context = F.concat_ws(_SEP, F.when(python, "py").otherwise(""), *(F.when(typed, c).otherwise("") for c in (F.ltrim(F.col("receiver_type"), F.lit("*")), module, F.coalesce(F.substring_index("from_qn", ".", 1), F.lit("")), F.when(script, "script").otherwise(""))))
    name = _absolute(F.col("to_name"), F.col("from_file"))
    refs = written(refs.select("project_id", "from_file", "from_qn", "kind", "confidence", name.alias("name"), context.alias("context")).where("name is not null"))
    table = written(targets(nodes, "file", "any", "qn", "name", "method", "member"))
    on = ["project_id", "name", "context"]
    keys = refs.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    part = lambda k: F.element_at(F.split("context", _SEP), k)
    name, last, parts = F.col("name"), F.substring_index("name", ".", -1), F.size(F.split("name", r"\."))
    receiver, before = part(2), F.substring(name, 1, F.length(name) - F.length(last) - 1)
    plain = (receiver != "") & ~F.contains(receiver, F.lit(".")) & ~F.substring_index("name", ".", 1).isin(*STANDARD)
    probes = [
        ("1 qualified name", "qn", name),
        *_rooted(name, part(1) == "py"),
        ("2 bare name", "name", _undotted(name)),
        *(("3 receiver type", "qn", F.when(plain & (parts == 2) & (part(k) != ""), F.concat_ws(".", part(k), receiver, last))) for k in (3, 4)),
        ("4 class member", "member", F.when((receiver != "") & (parts == 2) & (part(5) == "script"), F.concat_ws(".", receiver, last))),
        ("5 only method", "method", F.when((parts > 1) & (last != "") & ~before.isin(*STANDARD) & ~last.isin(*COMMON_METHODS), last)),
    ]
    if struct_fields is not None:
        types = struct_fields.groupBy("project_id", "struct_qn", "field_name").agg(F.min(F.ltrim(F.col("field_type"), F.lit("*"))).alias("field_type"))
        through = keys.where(plain & (parts == 3)).select(*on, F.explode(F.array(part(3), part(4))).alias("__p"), receiver.alias("__r")).select(*on, "__p", F.concat_ws(".", "__p", "__r").alias("struct_qn"), F.element_at(F.split("name", r"\."), 2).alias("field_name"))
        field = through.join(types, ["project_id", "struct_qn", "field_name"]).where("field_type not like '%.%'").groupBy(*on).agg(F.min(F.concat_ws(".", "__p", "field_type", F.substring_index("name", ".", -1))).alias("__field"))
        keys = keys.join(field, on, "left")
        probes.insert(-2, ("3 receiver type", "qn", F.col("__field")))
    found = written(resolve(keys, on, probes, table))
    bound = keyed_join(refs, found, on, ("to_id", "label"), total=total)
    return finish(with_sources(bound, table, _from("name"), total))


def resolve_imports(pending_edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IMPORTS edges and the external modules made for targets that no project node has.

    Names of Python files are tried as written, resolved if they are relative,
    and below each of ROOTS.
    """
    total, python = pending_edges.count(), _python(F.col("from_file"))
    refs = pending(pending_edges, "IMPORTS").withColumn("python", python).withColumn("name", _absolute(F.col("to_name"), F.col("from_file"))).where("name is not null")
    refs, table = written(refs), written(targets(nodes, "file", "any", "name"))
    on = ["project_id", "name", "python"]
    keys = refs.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    rooted = [(label, "any", c) for label, _, c in _rooted(F.col("name"), F.col("python"))]
    hit = resolve(keys, on, [("1 qualified name", "any", F.col("name")), *rooted], table).drop("n")
    known = written(keys.join(hit, on, "left"))
    path = F.concat(F.lit("@external/"), F.col("name"))
    outside = F.concat(path, F.lit("::"), F.col("name"), F.lit("#Module"))
    made = known.where("to_id is null").select("project_id", "name").distinct().select("project_id", outside.alias("id"), path.alias("file_path"), "name", F.col("name").alias("qualified_name"), F.lit("Module").alias("kind"), F.lit("External").alias("language"))
    all_keys = known.select(*on, "n", F.coalesce("to_id", outside).alias("to_id"), F.coalesce("label", F.lit("2 external")).alias("label"))
    return finish(with_sources(keyed_join(refs, all_keys, on, ("to_id", "label"), total=total), table, _from("name"), total)), made


def resolve_reads(pending_edges: DataFrame, nodes: DataFrame, struct_fields: DataFrame | None = None) -> DataFrame:
    """READS and WRITES edges to variables of the reader's language.

    A name is looked up as a qualified name, then as a variable, function or
    method of the same language and directory.  A target that is a function
    becomes a call of confidence 0.4, unless its name is one of every type's
    methods or the read is that of a struct's field; other targets are dropped.
    """
    total = pending_edges.count()
    refs, table = pending(pending_edges, "READS", "WRITES"), written(targets(nodes, "file", "any", "value", "value anywhere"))
    refs = with_sources(refs, table, _from("value anywhere"), total).withColumn("folder", F.coalesce(directory_of(F.col("from_file")), F.lit("")))
    refs = written(refs)
    on = ["project_id", "to_name", "from_language", "folder"]
    keys = refs.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    same = F.col("to_language") == F.col("from_language")
    # both ways of naming, each with the number of references
    by_qn = resolve(keys, on, [("1 qualified name", "any", F.col("to_name"))], table).where(same)
    by_name = resolve(keys, on, [("2 same package", "value", F.when(_undotted(F.col("to_name")).isNotNull(), F.concat_ws(_SEP, "from_language", "folder", "to_name")))], table)
    # a name in dots can't be bare; the qualified name wins where its language is the reader's
    found = written(by_qn.unionByName(by_name).groupBy(*on).agg(F.max("n").alias("n"), F.min(F.struct("label", "to_id", "to_kind")).alias("b")).select(*on, "n", "b.*"))
    bound = keyed_join(refs, found, on, ("to_id", "to_kind", "label"), total=total)
    call = F.col("to_kind").isin("Function", "Method")
    field = F.lit(False)
    if struct_fields is not None:
        own = struct_fields.select("project_id", F.col("struct_qn").alias("base"), F.col("field_name").alias("to_name"), F.lit(True).alias("__field")).distinct()
        forms = F.array("base_type", F.concat_ws(".", F.substring_index("from_qn", ".", 1), "base_type"))
        reads = bound.where("base_type is not null").select("project_id", "from_qn", "base_type", "to_name", F.explode(forms).alias("base")).join(own, ["project_id", "base", "to_name"]).select("project_id", "from_qn", "base_type", "to_name", "__field").distinct()
        bound = bound.join(reads, ["project_id", "from_qn", "base_type", "to_name"], "left")
        field = F.coalesce("__field", F.lit(False))
    last = F.substring_index("to_name", ".", -1)
    kept = bound.where((F.col("to_kind") == "Variable") | (call & ~last.isin(*COMMON_METHODS) & ~field))
    e = kept.select("project_id", "from_id", "to_id", F.when(call, "CALLS").otherwise(F.col("kind")).alias("kind"), F.when(call, F.lit(0.4)).otherwise(F.col("confidence")).alias("confidence"), "label")
    return finish(e).withColumn("source", F.when(F.col("kind") == "CALLS", "binding_pass").otherwise(F.col("source")))


def resolve_settings(pending_edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """USES_VAR edges to settings of variable files by name, and the modules made for files without a node.

    The source is the file's module by name, else the least node of the file,
    else a module made for it.
    """
    total = pending_edges.count()
    refs, table = written(pending(pending_edges, "USES_VAR")), written(targets(nodes, "setting", "module", "in file"))
    to = ["project_id", "to_name"]
    keys = refs.groupBy(*to).agg(F.count(F.lit(1)).alias("n"))
    bound = keyed_join(refs, written(resolve(keys, to, [("1 setting", "setting", F.col("to_name"))], table)), to, ("to_id", "label"), total=total)
    on = ["project_id", "from_file", "source"]
    bound = bound.withColumn("source", F.coalesce("from_qn", F.lit("")))
    here = bound.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    base = F.regexp_replace(F.substring_index("from_file", "/", -1), r"\.[^.]*$", "")
    stem = F.coalesce(F.nullif("source", F.lit("")), base)
    own = F.concat(F.col("from_file"), F.lit("::"), stem, F.lit("#Module"))
    found = here.join(resolve(here, on, [("1", "module", F.nullif("source", F.lit(""))), ("2", "in file", F.col("from_file"))], table), on, "left").select(*on, F.coalesce("to_id", own).alias("from_id"), F.col("to_id").isNull().alias("made"))
    made = found.where("made").select("project_id", F.col("from_id").alias("id"), F.col("from_file").alias("file_path"), stem.alias("name"), stem.alias("qualified_name"), F.lit("Module").alias("kind"), F.lit(0.5).alias("extraction_confidence")).distinct()
    return finish(bound.join(found.drop("made"), on)), made


#: Ends of file names that choose a platform.
PLATFORMS = r"_(?:linux|windows|darwin|freebsd|netbsd|openbsd|android|ios|js|wasm|unix|other|stub|amd64|arm64|arm|386)(?=\.\w+$|_)"


def platform_siblings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges to the same function in the files of other platforms: one more edge for each sibling of a target.

    A function has as many siblings as there are platforms, so pairs of them are few.
    """
    plain = F.regexp_replace(F.col("file_path"), PLATFORMS, "")
    n = nodes.where(F.col("language") == "Go").select("project_id", "id", "name", "kind", "file_path", plain.alias("stem"))
    families = n.join(n.where("stem <> file_path").select("project_id", "stem").distinct(), ["project_id", "stem"], "left_semi")
    a, b = families.select("project_id", "stem", "name", "kind", F.col("id").alias("to_id")), families.select("project_id", "stem", "name", "kind", F.col("id").alias("other"))
    siblings = a.join(b, ["project_id", "stem", "name", "kind"]).where("to_id <> other").select("project_id", "to_id", "other")
    return edges.join(siblings, ["project_id", "to_id"]).select("project_id", "from_id", F.col("other").alias("to_id"), *(c for c in edges.columns if c not in ("project_id", "from_id", "to_id"))).where("from_id <> to_id")


def scope(pending_edges: DataFrame, changed: DataFrame, referrers: DataFrame, threshold: int = 64) -> DataFrame:
    """References to resolve again: those of changed files and of files that refer to them, or all if these are many."""
    files = changed.select("project_id", "file_path").unionByName(referrers.select("project_id", F.col("referrer").alias("file_path"))).distinct()
    if files.limit(threshold + 1).count() > threshold:
        return pending_edges
    return pending_edges.join(F.broadcast(files.withColumnRenamed("file_path", "from_file")), ["project_id", "from_file"], "left_semi")


def replace_scoped(edges: DataFrame, fresh: DataFrame, nodes: DataFrame, kinds: list[str], files: DataFrame | None = None) -> DataFrame:
    """Edges with those that an earlier pass resolved replaced: of all files, or of the files (project_id, file_path) only."""
    old = F.col("kind").isin(kinds) & F.col("source").isin("resolve_pass", "binding_pass")
    if files is None:
        return edges.where(~old).unionByName(fresh, allowMissingColumns=True)
    inside = nodes.join(files.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_semi").select("project_id", F.col("id").alias("from_id"), F.lit(True).alias("__gone"))
    kept = edges.join(inside, ["project_id", "from_id"], "left").where(~(old & F.coalesce("__gone", F.lit(False)))).drop("__gone")
    return kept.select(*edges.columns).unionByName(fresh, allowMissingColumns=True)


def trace_start(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(project_id, name, id): the node that a name stands for: production functions first, tests and fixtures last."""
    order = F.struct(F.coalesce(is_fixture(F.col("file_path")), F.lit(False)).alias("a"), F.coalesce(is_test_file(F.col("file_path")), F.lit(False)).alias("b"), F.when(F.col("kind") == "Function", 0).when(F.col("kind") == "Method", 1).when(F.col("kind") == "Class", 2).when(F.col("kind") == "Module", 9).otherwise(5).alias("c"), "id")
    return nodes.join(names.select("project_id", "name").distinct(), ["project_id", "name"], "left_semi").groupBy("project_id", "name").agg(F.min(order).alias("o")).select("project_id", "name", "o.id")


def current_ids(ids: DataFrame, moves: DataFrame) -> DataFrame:
    """(project_id, old_id, id): ids led to where their nodes have moved (project_id, old_id, new_id), one step."""
    return ids.select("project_id", F.col("id").alias("old_id")).join(moves, ["project_id", "old_id"], "left").select("project_id", "old_id", F.coalesce("new_id", "old_id").alias("id"))


def resolve_all(pending_edges: DataFrame, symbols: DataFrame, struct_fields: DataFrame | None = None) -> DataFrame:
    """All resolved edges of an append log of symbols; the nodes in force are made once and written to the shared folder."""
    nodes = written(nodes_in_force(symbols))
    parts = [resolve_calls(pending_edges, nodes, struct_fields), resolve_imports(pending_edges, nodes)[0], resolve_reads(pending_edges, nodes, struct_fields)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
