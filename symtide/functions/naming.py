"""Names, prototypes, attributes and locations of symbols as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A C++ class name as written, with up to three levels of template arguments; the same in Java and RE2.
NAME = r"(?:::)?[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*(?:<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)?"


def base_list(c: Column) -> Column:
    """The names in a packed list of base classes, whatever parts them; stays in the JVM."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NAME), F.lit(0))


def without_template(c: Column) -> Column:
    return F.substring_index(c, "<", 1)


def simple_name(c: Column) -> Column:
    """The last component; template arguments go only where they end the name, so ``operator<`` stays."""
    bare = F.when(c.endswith(">") & ~c.rlike(r"operator\W*$"), F.substring_index(c, "<", 1)).otherwise(c)
    return F.substring_index(bare, "::", -1)


def namespace_of(qualified: Column) -> Column:
    """Everything before the last ``::``; for a method that holds its class."""
    return F.when(F.instr(qualified, "::") > 0, F.substring(qualified, F.lit(1), F.length(qualified) - F.length(F.substring_index(qualified, "::", -1)) - 2)).otherwise("")


def put_first(text: Column, find: Column, put: Column) -> Column:
    """``text`` with the first ``find`` replaced by ``put``; as it is where there is none."""
    pos = F.call_function("locate", find, text)
    return F.when((pos > 0) & (F.length(find) > 0), F.concat(F.substring(text, F.lit(1), pos - 1), put, F.substring(text, pos + F.length(find), F.length(text)))).otherwise(text)


def scoped_signature(signature: Column, name: Column, scope: Column) -> Column:
    return put_first(signature, F.concat(name, F.lit("(")), F.concat(scope, F.lit("::"), name, F.lit("(")))


def function_prototype(s: dict[str, Column] | None = None) -> Column:
    """[access] [virtual|static] signature with the qualified name [= 0]; null without a signature."""
    c = s or {k: F.col(k) for k in ("signature", "parent_class", "access", "is_pure_virtual", "is_virtual", "is_static", "name", "qualified_name")}
    truth = lambda k: F.coalesce(c[k], F.lit(False))
    full = lambda k: F.coalesce(c[k], F.lit("")) != ""
    sig = F.when(full("qualified_name") & full("name") & (c["qualified_name"] != c["name"]), put_first(c["signature"], F.concat(c["name"], F.lit("(")), F.concat(c["qualified_name"], F.lit("(")))).otherwise(c["signature"])
    sig = F.when(truth("is_pure_virtual") & ~sig.contains("= 0"), F.concat(F.rtrim(sig), F.lit(" = 0"))).otherwise(sig)
    access = F.when(full("parent_class") & full("access"), c["access"])
    spec = F.when(truth("is_pure_virtual") | truth("is_virtual"), "virtual").when(truth("is_static"), "static")
    return F.when(full("signature"), F.concat_ws(" ", access, spec, sig))


def class_prototype(qualified: Column, kind: Column, bases: Column, parameters: Column | None = None) -> Column:
    """[template<...> ]class|struct name[ : bases]; ``parameters`` are structs (name, kind)."""
    head = F.lit("")
    if parameters is not None:
        one = lambda p: F.when(F.coalesce(p["kind"], F.lit("type")).isin("type", ""), F.trim(F.concat(F.lit("typename "), F.coalesce(p["name"], F.lit(""))))).otherwise(F.coalesce(F.nullif(p["name"], F.lit("")), F.lit("auto")))
        head = F.when(F.coalesce(F.size(parameters), F.lit(0)) > 0, F.concat(F.lit("template<"), F.array_join(F.transform(parameters, one), ", "), F.lit("> "))).otherwise("")
    word = F.when(kind == "struct", "struct ").otherwise("class ")
    tail = F.when(F.size(bases) > 0, F.concat(F.lit(" : "), F.array_join(bases, ", "))).otherwise("")
    return F.when(F.coalesce(qualified, F.lit("")) != "", F.concat(head, word, qualified, tail))


def attributes() -> Column:
    """pure_virtual or virtual, const, static, definition: those that hold, or null."""
    t = lambda k: F.coalesce(F.col(k), F.lit(False))
    got = F.array_compact(
        F.array(F.when(t("is_pure_virtual"), "pure_virtual").when(t("is_virtual"), "virtual"), F.when(t("is_const"), "const"), F.when(t("is_static"), "static"), F.when(t("is_definition"), "definition"))
    )
    return F.when(F.size(got) > 0, got)


def locations() -> Column:
    """(declaration, definition) structs: apart where a header holds the declaration."""
    here = F.struct(F.col("file"), F.col("line"), F.col("start_line"), F.col("end_line"))
    head = F.struct(F.col("header_file").alias("file"), F.col("header_line").alias("line"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    apart = F.coalesce(F.col("header_file"), F.lit("")) != ""
    defined = F.coalesce(F.col("is_definition"), F.lit(False))
    return F.struct(F.when(apart, head).when(~defined, here).alias("declaration"), F.when(apart | defined, here).alias("definition"))


def template_base_of_usr(usr: Column) -> Column:
    """The template a specialisation's USR names, in any namespace; null if it names none."""
    hit = F.regexp_extract(usr, r"@(?:S|C|ST|SP)>?[^@]*@([A-Za-z_]\w*)(?:>#|<#)", 1)
    return F.when(hit != "", hit)


def project_file(file: Column, root: str, dependency_dirs: tuple[str, ...]) -> Column:
    """Below ``root`` and with no dependency directory anywhere in the path."""
    parts = F.split(F.substring(file, F.lit(len(root) + 2), F.length(file)), "/")
    return file.startswith(root.rstrip("/") + "/") & ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in dependency_dirs]))


def skipped_file(file: Column, root: str, excluded: tuple[str, ...], include_dependencies: bool = False) -> Column:
    """Outside ``root`` (unless dependencies count) or with an excluded directory first."""
    inside = file.startswith(root.rstrip("/") + "/")
    first = F.element_at(F.split(F.substring(file, F.lit(len(root) + 2), F.length(file)), "/"), 1)
    return F.when(inside, first.isin(*excluded)).otherwise(F.lit(not include_dependencies))


def brief_of(comment: Column, limit: int = 200) -> Column:
    """The text after a brief tag, else the first line that is no tag; at most ``limit`` characters."""
    lines = F.filter(F.transform(F.split(comment, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s*(?:/\*+!?|//[/!]*<?|\*+/|\*+)\s*|\s*\*+/\s*$", "")), lambda x: F.length(F.trim(x)) > 0)
    tagged = F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"[@\\](?:brief|short)\s+(\S.*)$", 1)), lambda x: x != ""), F.lit(0))
    plain = F.get(F.filter(lines, lambda x: ~x.rlike(r"^\s*[@\\]") & x.rlike(r"\w")), F.lit(0))
    return F.substring(F.trim(F.coalesce(tagged, plain)), 1, limit)


def doc_text(comment: Column, limit: int = 4000) -> Column:
    """A comment of at most ``limit`` characters, cut ones ending in an ellipsis."""
    return F.when(F.length(comment) > limit, F.concat(F.substring(comment, 1, limit - 3), F.lit("..."))).otherwise(comment)


def substituted_bases(bases: Column, parameters: Column, arguments: Column) -> Column:
    """Bases of an instantiation: a parameter's name or ``type-parameter-D-I`` gives way to its argument."""
    given = F.map_from_arrays(F.slice(parameters, F.lit(1), F.least(F.size(parameters), F.size(arguments))), F.slice(arguments, F.lit(1), F.least(F.size(parameters), F.size(arguments))))

    def one(b: Column) -> Column:
        at = F.regexp_extract(b, r"^type-parameter-\d+-(\d+)$", 1)
        return F.coalesce(given[b], F.when(at != "", F.get(arguments, at.try_cast("int"))), b)

    return F.transform(bases, one)


def resolved_bases(symbols: DataFrame) -> DataFrame:
    """``symbols`` (usr, bases, primary_usr, arguments) with the bases of instantiations that have none filled
    from their primary template (its bases and parameters)."""
    primary = symbols.select(F.col("usr").alias("primary_usr"), F.col("bases").alias("__b"), F.col("parameters").alias("__p"))
    met = symbols.join(primary, "primary_usr", "left")
    own = F.coalesce(F.size("bases"), F.lit(0)) > 0
    return met.withColumn("bases", F.when(own | F.col("__b").isNull(), F.col("bases")).otherwise(substituted_bases(F.col("__b"), F.col("__p"), F.coalesce("arguments", F.array().cast("array<string>"))))).drop("__b", "__p")
