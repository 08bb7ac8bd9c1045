"""Syntax nodes to symbols, calls and accesses, by rules on the path of node types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import stab
from ..functions.text import strip, symbol_id
from ..sources.shared import stage

_DECORATED = "(?:decorated_definition/)?"
_DECLARATOR = "(?:init_declarator|identifier|field_identifier|pointer_declarator|array_declarator)"
_TYPE = "(?:class|interface|enum|record|annotation_type)_declaration"
_MEMBER = rf"program/(?:{_TYPE}/[a-z_]*body/(?:enum_body_declarations/)?)+"
_SCOPE = "translation_unit/(?:namespace_definition/declaration_list/|template_declaration/)*"
_CLASSES = rf"{_SCOPE}(?:(?:class|struct)_specifier/field_declaration_list/(?:field_declaration/)?)*"
_IN_CLASS = rf"{_CLASSES}(?:class|struct)_specifier/field_declaration_list/"
_C_TYPES = "translation_unit/(?:type_definition/)?"

#: Language -> (kind, pattern of the type path), the first that fits counts (the kinds and node types are fixed values).
RULES = {
    "python": (
        ("class", rf"module/{_DECORATED}class_definition"),
        ("function", rf"module/{_DECORATED}function_definition"),
        ("method", rf"module/{_DECORATED}class_definition/block/{_DECORATED}function_definition"),
        ("variable", rf"module/(?:{_DECORATED}class_definition/block/)?(?:{_DECORATED}function_definition/block/)?expression_statement/assignment"),
    ),
    "java": (
        ("import", "program/import_declaration"),
        ("type", rf"(?:program/|{_MEMBER}){_TYPE}"),
        ("variable", rf"{_MEMBER}field_declaration/variable_declarator"),
        ("method", rf"{_MEMBER}method_declaration"),
        ("constructor", rf"{_MEMBER}constructor_declaration"),
        ("enum_member", rf"(?:program/|{_MEMBER})enum_declaration/enum_body/enum_constant"),
        ("variable", rf"{_MEMBER}(?:method|constructor)_declaration/(?:block|constructor_body)/(?:.*/)?local_variable_declaration/variable_declarator"),
    ),
    "c": (
        ("function", "translation_unit/function_definition"),
        ("variable", rf"translation_unit/(?:function_definition/compound_statement/)?declaration/{_DECLARATOR}"),
        ("type", "translation_unit/(?:struct|union|enum)_specifier"),
        ("variable", rf"{_C_TYPES}(?:struct|union)_specifier/field_declaration_list/field_declaration/{_DECLARATOR}"),
        ("enum_member", rf"{_C_TYPES}enum_specifier/enumerator_list/enumerator"),
    ),
    "cpp": (
        ("namespace", rf"{_SCOPE}namespace_definition"),
        ("type_alias", rf"{_SCOPE}alias_declaration"),
        ("import", rf"{_SCOPE}using_declaration"),
        ("type", rf"{_CLASSES}(?:class|struct|union|enum)_specifier"),
        ("function", rf"{_SCOPE}function_definition"),
        ("method", rf"{_IN_CLASS}function_definition"),
        ("variable", rf"(?:{_SCOPE}|(?:{_SCOPE}|{_IN_CLASS})function_definition/compound_statement/)declaration/{_DECLARATOR}"),
        ("variable", rf"{_IN_CLASS}field_declaration/{_DECLARATOR}"),
        ("variable", rf"{_CLASSES}union_specifier/field_declaration_list/field_declaration/{_DECLARATOR}"),
        ("enum_member", rf"{_CLASSES}enum_specifier/enumerator_list/enumerator"),
    ),
}
#: Node types whose names make up the qualified name of what is inside them (fixed values).
SCOPES = {
    "python": ("class_definition", "function_definition"),
    "java": ("class_declaration", "interface_declaration", "enum_declaration", "record_declaration", "annotation_type_declaration", "method_declaration", "constructor_declaration"),
    "c": ("function_definition", "struct_specifier", "union_specifier", "enum_specifier"),
    "cpp": ("namespace_definition", "class_specifier", "struct_specifier", "union_specifier", "enum_specifier", "function_definition"),
}
#: Node type of a type to its kind (fixed values).
TYPE_KINDS = {"class_declaration": "class", "interface_declaration": "interface", "enum_declaration": "enum", "record_declaration": "record", "annotation_type_declaration": "annotation", "class_specifier": "class", "struct_specifier": "struct", "union_specifier": "union", "enum_specifier": "enum"}
#: Below a symbol: where its parameters and super types are, as patterns of the rest of the type path.
PARAMETERS = {"java": "formal_parameters/formal_parameter", "c": r"(?:[a-z_]+_declarator/)*function_declarator/parameter_list/parameter_declaration", "cpp": r"(?:[a-z_]+_declarator/)*function_declarator/parameter_list/parameter_declaration"}
SUPER_TYPES = {"java": r"(?:superclass|super_interfaces|extends_interfaces)/(?:.*/)?(?:type_identifier|generic_type|scoped_type_identifier)", "cpp": "base_class_clause/(?:type_identifier|qualified_identifier|template_type)"}
#: Node types whose text is the code of the declarators below them (fixed values).
DECLARATIONS = ("field_declaration", "local_variable_declaration", "declaration", "type_definition")
WITH_BODY = ("class", "interface", "enum", "record", "annotation", "struct", "union", "namespace", "function", "method", "constructor")


def _by_language(values: dict, make) -> Column:
    out = F.lit(None)
    for language, value in values.items():
        out = F.when(F.col("language") == language, make(value)).otherwise(out)
    return out


def symbol_kind() -> Column:
    """The kind of a node's symbol, null if the node makes none."""

    def of(rules):
        out = F.lit(None).cast("string")
        for kind, pattern in reversed(rules):
            named = F.create_map(*[F.lit(x) for p in TYPE_KINDS.items() for x in p])[F.col("type")] if kind == "type" else F.lit(kind)
            out = F.when(F.col("type_path").rlike(rf"\A{pattern}\z"), named).otherwise(out)
        return out

    alias = (F.col("language") == "c") & F.col("type_path").rlike(r"\Atranslation_unit/type_definition/[^/]+\z")
    aliased = F.when(F.col("field") == "declarator", "type_alias").when(F.col("field") == "type", F.coalesce(F.create_map(*[F.lit(x) for p in TYPE_KINDS.items() for x in p])[F.col("type")], F.lit("enum")))
    return F.when(alias, aliased).otherwise(_by_language(RULES, of))


def _bytes(text: Column, start: Column, count: Column) -> Column:
    """A slice of a text by bytes."""
    return F.decode(F.call_function("substring", F.encode(text, "utf-8"), (start + 1).cast("int"), count.cast("int")), "utf-8")


def signature_of(text: Column, start: Column, body_start: Column) -> Column:
    """The source up to the body, stripped; the whole text without a body."""
    return strip(F.when(body_start.isNotNull(), _bytes(text, F.lit(0), body_start - start)).otherwise(text))


def body_of(text: Column, start: Column, body_start: Column, body_end: Column) -> Column:
    return F.when(body_start.isNotNull(), _bytes(text, body_start - start, body_end - body_start)).otherwise("")


def absolute(nodes: DataFrame) -> DataFrame:
    """``nodes`` as they are; a relative path is an error, as files of two repositories could share it (see ``storage_path``)."""
    known = F.col("path").startswith("/") | F.col("path").rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:/")
    return nodes.withColumn("path", F.when(known, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("not an absolute path: "), F.coalesce("path", F.lit("null"))))))


def file_symbols(nodes: DataFrame) -> DataFrame:
    """One symbol for each file, from its root node."""
    root = nodes.where("parent_id is null and not parse_error")
    return _symbols(root.select("*", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("parent_name"), F.substring_index("path", "/", -1).alias("own"), F.col("path").alias("full"), F.col("path").alias("sig"), F.col("text").alias("code"), F.lit("").alias("inside"), F.lit(None).cast("string").alias("aliased_type"), F.lit(False).alias("static")))


def _symbols(rows: DataFrame) -> DataFrame:
    return rows.select(
        "repo_id", symbol_id(F.col("kind"), F.col("path"), F.col("full"), F.col("start_line")).alias("id"), "kind", "language", "path", F.col("own").alias("name"), F.col("full").alias("qualified_name"), F.col("sig").alias("signature"),
        "start_line", "start_column", "end_line", "end_column", "code", F.col("inside").alias("body"), "parent_name", "aliased_type", F.col("static").alias("is_static"), F.col("node_id").alias("ordinal"), "type_path", "start_byte", "end_byte",
    )


def extract_symbols(nodes: DataFrame) -> DataFrame:
    """Symbols of all files with ``parameters`` and ``super_types``; the order is that of the nodes.

    The kind, names, signature, code and body come from the node's own row, but for declarators, whose code is their
    declaration, and for Java packages. So symbols of Python files need no other row: they are made in one pass without a
    shuffle, with their file's.
    """
    python = F.col("language") == "python"
    root = F.when(F.col("parent_id").isNull(), "file")
    own = absolute(nodes.where(python)).where("not parse_error").withColumn("kind", F.explode(F.array_compact(F.array(symbol_kind(), root))))
    none = lambda df, names, of: df.select("*", *[F.lit(None).cast(of).alias(c) for c in names])
    plain = none(_named(none(own, ("up_text", "package", "type_text"), "string")), ("parameters", "super_types"), "array<string>")
    others = nodes.where(~F.coalesce(python, F.lit(False)))
    found = plain.drop("type_path", "start_byte", "end_byte").unionByName(_of_declarations(others))
    empty = F.array().cast("array<string>")
    return found.withColumn("parameters", F.coalesce("parameters", empty)).withColumn("super_types", F.coalesce("super_types", empty))


def _of_declarations(nodes: DataFrame) -> DataFrame:
    """Symbols of languages whose nodes take text from others."""
    nodes = absolute(nodes)
    rows = nodes.where("not parse_error").withColumn("kind", symbol_kind()).where("kind is not null")
    # Only declarations lend their text to their declarators, and only Java files have a package.
    up = nodes.where(F.col("type").isin(*DECLARATIONS)).select("path", F.col("node_id").alias("parent_id"), F.col("text").alias("up_text"))
    package = nodes.where("type = 'package_declaration'").groupBy("path").agg(F.min_by("name", "node_id").alias("package"))
    of_type = nodes.where("field = 'type' and (type_path like '%type_definition/%' or type_path like '%alias_declaration/%')").select("path", "parent_id", F.col("text").alias("type_text"))
    rows = rows.join(up, ["path", "parent_id"], "left").join(package, "path", "left").join(of_type.groupBy("path", "parent_id").agg(F.first("type_text").alias("type_text")), ["path", "parent_id"], "left")
    return _with_lists(_named(rows).unionByName(file_symbols(nodes)), nodes)


def _named(rows: DataFrame) -> DataFrame:
    """Symbols of nodes with their ``kind``, the text of their declaration and of its type, and their package."""
    kind, language, python = F.col("kind"), F.col("language"), F.col("language") == "python"
    scopes = _by_language(SCOPES, lambda types: F.filter(F.col("anc_names"), lambda a: a["type"].isin(*types)))
    # A local variable belongs to the outermost callable around it, whatever is between.
    calls = F.filter(F.transform(scopes, lambda a, i: F.struct(a["type"].alias("type"), i.alias("i"))), lambda a: a.type.isin("method_declaration", "constructor_declaration"))
    scopes = F.when((language == "java") & (F.size(calls) > 0), F.slice(scopes, 1, F.get(calls, 0).i + 1)).otherwise(scopes)
    chain = F.transform(scopes, lambda a: F.coalesce(F.nullif(a["name"], F.lit("")), F.concat(F.lit("<anonymous-"), F.regexp_replace(a["type"], "_.*", ""), F.lit(">"))))
    parent = F.nullif(F.array_join(F.concat(F.when(F.col("package").isNotNull(), F.array("package")).otherwise(F.array().cast("array<string>")), chain), "."), F.lit(""))
    own_type = F.get(chain, F.size(chain) - 1)
    raw = F.nullif(strip(F.when(kind == "type_alias", F.coalesce("name", "text")).otherwise(F.col("name"))), F.lit(""))
    default = F.concat(F.lit("<anonymous-"), F.when(kind.isin("class", "interface", "record", "annotation") & (language == "java"), "type").when(kind == "enum_member", "member").otherwise(kind), F.lit(">"))
    own = F.coalesce(F.when(kind == "constructor", own_type).when((kind == "import") & (language == "java"), F.substring_index(raw, ".", -1)).when((kind == "import") & (language == "cpp"), F.substring_index(raw, "::", -1)).otherwise(raw), default)
    static = (kind == "import") & (language == "java") & F.col("text").rlike(r"\Aimport\s+static\s")
    full = F.when((kind == "import") & (language == "java"), F.concat(F.when(static, "static:").otherwise(""), F.coalesce(raw, default))).when(kind == "import", F.coalesce(raw, default))
    full = F.coalesce(full, F.when(F.col("parent_name").isNotNull(), F.concat_ws(".", "parent_name", "own")), F.col("own"))
    declared = (kind == "variable") & ~python | (kind == "type_alias") & (language == "c")
    sig = signature_of(F.col("text"), F.col("start_byte"), F.col("body_start_byte"))
    sig = F.when(python & (kind == "class"), F.concat(F.lit("class "), "own")).when(python & (kind == "variable"), F.concat("own", F.lit(" = ..."))).when(python, F.regexp_replace(sig, r":+\z", "")).when(declared, strip(F.col("up_text"))).when(kind.isin("enum_member", "type_alias", "import"), strip(F.col("text"))).otherwise(sig)
    inside = F.when(kind.isin(*WITH_BODY), body_of(F.col("text"), F.col("start_byte"), F.col("body_start_byte"), F.col("body_end_byte")))
    rows = rows.withColumn("parent_name", F.when((language == "c") & (kind == "type_alias"), F.lit(None).cast("string")).otherwise(parent)).withColumn("own", own)
    rows = rows.withColumn("full", full).withColumn("sig", sig).withColumn("inside", inside).withColumn("static", static).withColumn("code", F.when(declared, F.col("up_text")).otherwise(F.col("text")))
    aliased = F.when((kind == "type_alias"), strip(F.coalesce("type_text", F.regexp_extract("text", r"(?s)=\s*(.*?);?\s*\z", 1))))
    # A file is named by its path.
    file = kind == "file"
    plain = {"parent_name": F.lit(None).cast("string"), "own": F.substring_index("path", "/", -1), "full": F.col("path"), "sig": F.col("path"), "inside": F.lit(""), "static": F.lit(False), "code": F.col("text")}
    for name, value in plain.items():
        rows = rows.withColumn(name, F.when(file, value).otherwise(F.col(name)))
    return _symbols(rows.withColumn("aliased_type", aliased))


def _with_lists(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parameter and super type texts, joined by span; super types once each, in first-seen order."""
    wanted = nodes.where(F.col("type").isin("formal_parameter", "parameter_declaration", "type_identifier", "generic_type", "scoped_type_identifier", "qualified_identifier", "template_type"))
    below = wanted.select("path", F.col("node_id").alias("n"), F.col("type_path").alias("n_path"), F.col("start_byte").alias("n_start"), F.col("end_byte").alias("n_end"), strip(F.col("text")).alias("n_text"), F.col("parent_id").alias("n_parent"), F.col("start_line").alias("n_line"))
    holders = symbols.where("language <> 'python' and kind not in ('file', 'variable', 'import')").select("path", "ordinal", "language", "type_path", "start_byte", "end_byte", "start_line", "end_line")
    pairs = stab(below, holders, ["path"], "n_line", "start_line", "end_line").where("n_start >= start_byte and n_end <= end_byte and n > ordinal and startswith(n_path, concat(type_path, '/'))")
    pairs = pairs.withColumn("rest", F.expr("substring(n_path, length(type_path) + 2)"))
    is_one = lambda patterns: _by_language(patterns, lambda p: F.col("rest").rlike(rf"\A{p}\z"))
    pairs = pairs.withColumn("parameter", F.coalesce(is_one(PARAMETERS), F.lit(False))).withColumn("super", F.coalesce(is_one(SUPER_TYPES), F.lit(False))).where("parameter or super")
    item = F.struct("n_parent", "n", "n_text")
    lists = pairs.groupBy("path", "ordinal").agg(F.array_sort(F.collect_list(F.when(F.col("parameter"), item))).alias("ps"), F.array_sort(F.collect_list(F.when(F.col("super"), F.struct("n", "n_text")))).alias("ss"))
    first = F.filter("ps", lambda x: x.n_parent == F.get(F.col("ps"), 0).n_parent)
    lists = lists.select("path", "ordinal", F.transform(first, lambda x: x.n_text).alias("parameters"), F.array_distinct(F.transform("ss", lambda x: x.n_text)).alias("super_types"))
    return symbols.join(lists, ["path", "ordinal"], "left").drop("type_path", "start_byte", "end_byte")


def calls(nodes: DataFrame) -> DataFrame:
    """``(path, node_id, callee, span)`` of the call nodes; the name of such a node is the callee's text."""
    c = nodes.where(F.col("type").isin("call", "call_expression", "method_invocation") & F.col("name").isNotNull())
    return c.select("path", "node_id", strip(F.col("name")).alias("callee"), "start_line", "start_column", "end_line", "end_column")


#: Language -> (type of the statement, fields or types of the parts written, of the parts read); the last child of a return is read.
ACCESSES = {
    "python": (("assignment", ("left",), ("right",)),),
    "java": (("variable_declarator", ("name",), ("value",)), ("assignment_expression", ("left",), ("right",))),
    "c": (("init_declarator", ("declarator",), ("value",)), ("assignment_expression", ("left",), ("right",))),
    "cpp": (("init_declarator", ("declarator",), ("value",)), ("assignment_expression", ("left",), ("right",))),
}
_CALL_NODE = {"python": "call", "java": "method_invocation", "c": "call_expression", "cpp": "call_expression"}


#: Statements whose parts count.
STATEMENTS = sorted({rule[0] for rules in ACCESSES.values() for rule in rules} | {"return_statement"})
#: Node types that can be a reference.
LEAVES = ("identifier", "field_identifier", "attribute", "field_access")


def _wanted(nodes: DataFrame) -> DataFrame:
    """The nodes that references are made of, with the type of their parent: statements, their parts, and names."""
    up = F.when(F.col("type_path").contains("/"), F.substring_index(F.substring_index("type_path", "/", -2), "/", 1))
    leaf = F.col("type").isin(*LEAVES) | F.coalesce(F.col("field") == "object", F.lit(False))
    cols = ["path", "language", "node_id", "parent_id", "child_ord", "field", "type", "type_path", "start_line", "start_column", "end_line", "end_column", "start_byte", "end_byte"]
    rows = nodes.select(*cols, F.when(leaf, F.col("text")).alias("text"), leaf.alias("leaf"), up.alias("up_type"))
    return rows.where(F.col("leaf") | F.col("type").isin(*STATEMENTS) | F.coalesce(F.col("up_type").isin(*STATEMENTS), F.lit(False)))


def expressions(nodes: DataFrame) -> DataFrame:
    """The parts of statements that are written or read: ``(path, language, stmt, mode, node_id, type_path, span of the statement)``."""
    # The parent's type is the last but one of the path, so only parts of the statements that count meet their statement;
    # a node that is a part and a statement itself has a row as each.
    rows, span = _wanted(nodes), ("start_line", "start_column", "end_line", "end_column")
    part = ("language", "child_ord", "field", "type", "type_path", "node_id", "start_byte", "end_byte", "start_line", "end_line")
    none = F.lit(None)
    as_part = F.when(F.col("up_type").isin(*STATEMENTS), F.struct(F.col("parent_id").alias("stmt"), F.struct(*part).alias("part"), none.cast("struct<start_line:int,start_column:int,end_line:int,end_column:int>").alias("u")))
    as_statement = F.when(F.col("type").isin(*STATEMENTS), F.struct(F.col("node_id").alias("stmt"), none.cast(rows.select(F.struct(*part).alias("p")).schema["p"].dataType).alias("part"), F.struct(*[F.col(c).cast("int").alias(c) for c in span]).alias("u")))
    met = rows.select("path", F.explode(F.array_compact(F.array(as_part, as_statement))).alias("m")).groupBy("path", "m.stmt").agg(F.collect_list("m.part").alias("parts"), F.max("m.u").alias("u")).where("u is not null")
    met = met.select("path", F.col("stmt").alias("parent_id"), "u", F.array_max(F.transform("parts", lambda p: p.child_ord)).alias("last"), F.explode("parts").alias("p"))
    e = met.select("path", "parent_id", "last", "p.*", *[F.col(f"u.{c}").alias(f"u_{c}") for c in span])
    e = e.withColumn("up_path", F.expr("substring(type_path, 1, length(type_path) - length(substring_index(type_path, '/', -1)) - 1)")).withColumn("up_type", F.substring_index("up_path", "/", -1))

    def mode(rules):
        out = F.lit(None).cast("string")
        for type_, written, read in rules:
            here = F.col("up_type") == type_
            plain = F.lit(True) if type_ != "init_declarator" else F.col("type").isin("identifier", "field_identifier")
            out = F.when(here & F.col("field").isin(*written) & plain, "writes").when(here & F.col("field").isin(*read), "reads").otherwise(out)
        return F.when((F.col("up_type") == "return_statement") & (F.col("child_ord") == F.col("last")), "reads").otherwise(out)

    local = (F.col("up_type") != "variable_declarator") | F.col("up_path").rlike(r"local_variable_declaration/variable_declarator\z")
    e = e.withColumn("mode", _by_language(ACCESSES, mode)).where(F.col("mode").isNotNull() & local)
    return e.select("path", "language", F.col("parent_id").alias("stmt"), "mode", F.col("node_id").alias("e_id"), F.length("up_path").alias("cut"), F.col("start_byte").alias("e_start"), F.col("end_byte").alias("e_end"), F.col("start_line").alias("e_first"), F.col("end_line").alias("e_last"), *[F.col(f"u_{c}").alias(c) for c in ("start_line", "start_column", "end_line", "end_column")])


def reference_names(nodes: DataFrame) -> DataFrame:
    """``accesses`` for the relations: one row for each name that a written or read part refers to, in the order of the source.

    What is called is no reference, its arguments are; ``self.x`` and ``this.x`` are x, other attributes nothing; in
    Java the object of a call is a reference by its text; in C fields count by their name.
    """
    nodes = stage(_wanted(nodes), "wanted")
    r = nodes.where("leaf").select("path", F.col("node_id").alias("r_id"), F.col("type").alias("r_type"), F.col("field").alias("r_field"), F.col("type_path").alias("r_path"), F.col("start_byte").alias("r_start"), F.col("end_byte").alias("r_end"), F.col("start_line").alias("line"), strip(F.col("text")).alias("r_text"))
    # By line, so that a file's expressions don't all meet all its names.
    pairs = stab(r, stage(expressions(nodes), "expressions"), ["path"], "line", "e_first", "e_last", unit=1).where("r_start >= e_start and r_end <= e_end and r_id >= e_id").withColumn("rest", F.expr("substring(r_path, cut + 2)"))
    called = _by_language(_CALL_NODE, lambda t: F.col("rest").rlike(rf"(?:\A|/){t}/(?!argument_list)"))
    inside = F.col("rest").rlike("(?:attribute|field_access)/") & F.col("language").isin("python", "java")
    in_object = F.col("rest").rlike(r"method_invocation/(?!argument_list)[^/]+/") | F.col("rest").rlike(r"(?:\A|/)method_invocation/(?!argument_list)[^/]+/")
    is_object = (F.col("language") == "java") & (F.col("r_field") == "object") & F.col("rest").rlike(r"(?:\A|/)method_invocation/[^/]+\z") & ~in_object & (F.col("r_text") != "this")
    own = F.regexp_extract("r_text", r"\A(?:self|this)\s*\.\s*([^\s.()\[\]]+)\z", 1)
    name = F.when(is_object, F.col("r_text")).when(called | inside, None).when(F.col("r_type").isin("attribute", "field_access"), F.nullif(own, F.lit(""))).when(F.col("r_type") == "identifier", F.when(~((F.col("language") == "python") & (F.col("r_text") == "self") | (F.col("language") == "java") & (F.col("r_text") == "this")), F.col("r_text"))).when((F.col("r_type") == "field_identifier") & F.col("language").isin("c", "cpp"), F.col("r_text"))
    named = pairs.withColumn("name", name).where("name is not null and name <> ''")
    return named.select("path", F.col("stmt").alias("node_id"), F.col("r_id").alias("place"), "mode", "name", "start_line", "start_column", "end_line", "end_column")
