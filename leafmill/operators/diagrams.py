"""Diagrams as graph tables: cells, types, nodes, edges and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import clean_label, display_type, escape_cell, extension, is_attribute, is_class_member, is_column_only, is_drawio, is_meaningful, is_multiplicity, is_raw_id, named, no_blank, strip
from leafmill.operators.common import cut, distinct_ordered
from leafmill.operators.markup import attribute

# Words that tell the layer of an architecture node, tried in this order.
LAYERS = (
    ("inbound", ("web frontend", "order service", "other microservice")),
    ("controller-layer", ("controller",)),
    ("core-business-service", ("approverflowservice", "approve reject", "approvereject", "emailnotification")),
    ("supporting-service", ("techmanager", "additional", "historyservice", "replication")),
    ("cross-cutting-service", ("security", "userservice", "commonservice", "auditlogging")),
    ("domain-logic", ("approval flow", "business rule", "approver calculation", "validation logic")),
    ("data-mapping", ("mapper",)),
    ("data-access", ("repository", "repo")),
    ("database", ("postgres", "database", "db", "approval data", "audit history", "envers")),
    ("infrastructure", ("rabbit", "kafka", "queue", "topic", "hibernate", "cache", "configuration", "transaction", "infrastructure")),
    ("external-client", ("client", "keycloak", "gateway")),
    ("supporting-service", ("service",)),
    ("layer", ("layer",)),
)
# What labels of each diagram type look like.
STATE_TERMS = r"\b(WAIT|APPROVED|REJECTED|IN_PROGRESS|REQ_|RE_APPROVAL|START|RESTART)\b"
TRANSITION_TERMS = "approve|approval|reject|restart|review|provided"
CLASS_TERMS = r"\(\)|\b(Long|String|Date|Collection|Integer|Boolean)\s+\w+|\b[A-Z][A-Za-z0-9]*(New|Flow|Operation|Service|Mapper|Repo)\b"
ER_TERMS = " pk| fk|primary key|foreign key"
ARCHITECTURE_TERMS = "controller|service|repository|postgres|rabbit|gateway|client|infrastructure|layer|keycloak"


def _parts(files: DataFrame) -> DataFrame:
    """(file_id, pos, raw, page_ix, opens): the openings of pages and cells in each file of files(diagram_id, xml), with the number of the page that
    they are in; a file without pages is one page, and what lies before the first of others is none of theirs."""
    found = F.regexp_extract_all("xml", F.lit(r"(?s)<(?:mxCell|diagram)\b[^>]*>"), F.lit(0))
    rows = files.select(F.col("diagram_id").cast("string").alias("file_id"), F.posexplode(found).alias("pos", "raw")).withColumn("opens", F.col("raw").startswith("<diagram"))
    so_far = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("opened", F.sum(F.col("opens").cast("int")).over(so_far)).withColumn("all", F.max(F.col("opens").cast("int")).over(Window.partitionBy("file_id")))
    return rows.where("opened > 0 or all = 0").withColumn("page_ix", F.greatest(F.col("opened") - 1, F.lit(0)).cast("int")).drop("opened", "all")


def page_key(file_id: Column, page_ix: Column) -> Column:
    """The diagram_id of a file's page: the file's own for its first page."""
    return F.when(page_ix == 0, file_id).otherwise(F.concat(file_id, F.lit("#page-"), page_ix.cast("string")))


def diagram_pages(files: DataFrame) -> DataFrame:
    """(diagram_id, file_id, page_ix, diagram_name) of files(diagram_id, xml): a row a page, also for pages and files without a cell."""
    name = no_blank(strip(attribute(F.regexp_replace("raw", "^<diagram", ""), "name")))
    named = _parts(files).where("opens").select("file_id", "page_ix", name.alias("diagram_name"))
    bare = files.select(F.col("diagram_id").cast("string").alias("file_id")).join(named.select("file_id").distinct(), "file_id", "left_anti")
    out = named.unionByName(bare.select("file_id", F.lit(0).alias("page_ix"), F.lit(None).cast("string").alias("diagram_name")))
    return out.select(page_key(F.col("file_id"), F.col("page_ix")).alias("diagram_id"), "file_id", "page_ix", "diagram_name")


def diagram_cells(files: DataFrame) -> DataFrame:
    """(diagram_id, cell_id, parent_id, value, vertex, edge, source_id, target_id, style, ord) of files(diagram_id, xml).

    Each page of a file is a diagram of its own, so cells of two pages never meet, whatever their ids; see page_key for its diagram_id.
    """
    rows = _parts(files).where("not opens").select(page_key(F.col("file_id"), F.col("page_ix")).alias("diagram_id"), F.col("pos").alias("ord"), F.substring("raw", len("<mxCell") + 1, 1 << 30).alias("attrs"))
    a = lambda name: attribute(F.col("attrs"), name)
    key = lambda name: named(strip(a(name)), no_blank)
    return rows.select("diagram_id", key("id").alias("cell_id"), key("parent").alias("parent_id"), clean_label(a("value")).alias("value"), F.coalesce(a("vertex") == "1", F.lit(False)).alias("vertex"), F.coalesce(a("edge") == "1", F.lit(False)).alias("edge"), key("source").alias("source_id"), key("target").alias("target_id"), F.coalesce(a("style"), F.lit("")).alias("style"), "ord")


def diagram_labels(cells: DataFrame) -> DataFrame:
    """(diagram_id, label, ord): the labels of a diagram, each once at its first place."""
    return distinct_ordered(cells.where("value <> ''").select("diagram_id", F.col("value").alias("label"), "ord"), ["diagram_id", "label"], "ord")


def classify_diagrams(cells: DataFrame) -> DataFrame:
    """(diagram_id, type) by the terms in the labels: state, class, entity-relation, architecture, else generic, in that order."""
    low = F.lower("label")
    terms = diagram_labels(cells).groupBy("diagram_id").agg(
        F.count_if(F.upper("label").rlike(STATE_TERMS)).alias("state"),
        F.count_if(low.rlike(TRANSITION_TERMS)).alias("moves"),
        F.count_if(F.col("label").rlike(CLASS_TERMS)).alias("cls"),
        F.count_if(low.rlike(ER_TERMS)).alias("er"),
        F.count_if(low.rlike(ARCHITECTURE_TERMS)).alias("arch"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", low.alias("l")))), lambda x: x["l"]), " ").alias("all"),
    )
    directed = cells.groupBy("diagram_id").agg(F.count_if(F.col("edge") & F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).alias("directed"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    kind = (
        F.when((n("state") >= 2) & ((n("directed") >= 1) | (n("moves") >= 1)), "STATE_DIAGRAM")
        .when((n("cls") >= 3) | F.coalesce(F.col("all").contains("class diagram"), F.lit(False)), "CLASS_DIAGRAM")
        .when(n("er") >= 2, "ER_DIAGRAM")
        .when(n("arch") >= 4, "ARCHITECTURE_DIAGRAM")
        .otherwise("GENERIC_DIAGRAM")
    )
    return directed.join(terms, "diagram_id", "left").select("diagram_id", kind.alias("type"))


def degrees(cells: DataFrame) -> DataFrame:
    """(diagram_id, cell_id, outgoing, incoming) of the cells that edges touch."""
    e = cells.where("edge")
    ends = e.select("diagram_id", F.col("source_id").alias("cell_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select("diagram_id", "target_id", F.lit(0), F.lit(1))).where("cell_id is not null")
    return ends.groupBy("diagram_id", "cell_id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def layer(label: Column, style: Column) -> Column:
    low = F.lower(label)
    out = F.lit(None).cast("string")
    for name, words in reversed(LAYERS):
        out = F.when(low.rlike("|".join(words)), F.lit(name)).otherwise(out)
    return F.coalesce(out, style_type(style))


def style_type(style: Column) -> Column:
    """A node's shape by its style: the first part that names a shape, a swimlane or rounded corners, whole; null if none does."""
    return F.get(F.filter(F.split(style, ";"), lambda p: p.rlike("^(shape=|swimlane|rounded=)")), 0)


def class_members(cells: DataFrame) -> DataFrame:
    """(diagram_id, cell_id, attributes, methods, stereotypes) of vertices: from their own text and their children's, in order."""
    own = cells.where("vertex").select("diagram_id", "cell_id", "value", "ord")
    kids = cells.where("parent_id is not null").select("diagram_id", F.col("parent_id").alias("cell_id"), "value", (F.col("ord") + 1_000_000).alias("ord"))
    parts = own.unionAll(kids).select("diagram_id", "cell_id", "ord", F.posexplode(F.split("value", r"\n|\s{2,}")).alias("k", "line")).withColumn("line", strip(F.col("line")))
    parts = parts.where(is_meaningful(F.col("line")) & ~is_multiplicity(F.col("line")))
    kind = F.when(F.col("line").startswith("<<") & F.col("line").endswith(">>"), "stereotypes").when(F.col("line").contains("(") & F.col("line").contains(")"), "methods").when(is_attribute(F.col("line")), "attributes")
    first = parts.withColumn("kind", kind).where("kind is not null").groupBy("diagram_id", "cell_id", "kind", "line").agg(F.min(F.struct("ord", "k")).alias("at"))
    pick = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == name, F.struct("at", "line")))), lambda x: x["line"]).alias(name)
    return first.groupBy("diagram_id", "cell_id").agg(*[pick(k) for k in ("attributes", "methods", "stereotypes")])


def er_columns(cells: DataFrame) -> DataFrame:
    """(diagram_id, cell_id, columns): the labels of a vertex's children, each once in order."""
    kids = cells.where("parent_id is not null").select("diagram_id", F.col("parent_id").alias("cell_id"), "value", "ord").where(is_meaningful(F.col("value")) & ~is_multiplicity(F.col("value")))
    first = distinct_ordered(kids, ["diagram_id", "cell_id", "value"], "ord")
    return first.groupBy("diagram_id", "cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("columns"))


def _labelled(cells: DataFrame, types: DataFrame) -> DataFrame:
    """Cells with their diagram's type, degrees and, for state diagrams, the labels of start and end marks."""
    out = cells.join(types, "diagram_id").join(degrees(cells), ["diagram_id", "cell_id"], "left").fillna(0, ["outgoing", "incoming"])
    style = F.lower("style")
    start = F.col("vertex") & style.contains("ellipse") & style.rlike("fillcolor=(#000|black)|strokecolor=none") & (F.col("outgoing") > 0) & (F.col("incoming") == 0)
    end = F.col("vertex") & (F.col("incoming") > 0) & (style.rlike("doubleellipse|shape=endstate|shape=umlfinalstate|shape=mxgraph.uml25.final_state") | (style.contains("ellipse") & style.contains("fillcolor=#000000")))
    state = F.when(is_meaningful(F.col("value")), F.col("value")).when(start, "START").when(end, "END")
    return out.withColumn("label", F.when(F.col("type") == "STATE_DIAGRAM", state).otherwise(F.when(is_meaningful(F.col("value")), F.col("value"))))


def diagram_nodes(cells: DataFrame, types: DataFrame) -> DataFrame:
    """(diagram_id, label, type, ord, attributes, methods, stereotypes): the nodes of each diagram by its type, each label once."""
    c = _labelled(cells, types).withColumnRenamed("type", "dtype").join(class_members(cells), ["diagram_id", "cell_id"], "left").join(er_columns(cells), ["diagram_id", "cell_id"], "left")
    kids = cells.where("parent_id is not null").groupBy("diagram_id", F.col("parent_id").alias("cell_id")).agg(F.bool_or(is_class_member(F.col("value"))).alias("has_members"))
    c = c.join(kids, ["diagram_id", "cell_id"], "left")
    plain = F.col("label").isNotNull() & ~is_multiplicity(F.col("label"))
    is_class = F.col("vertex") & plain & ~is_class_member(F.col("value")) & (F.coalesce("has_members", F.lit(False)) | F.lower("style").rlike("swimlane|uml|class") | F.col("value").rlike(r"^[A-Z][A-Za-z0-9_]*$"))
    keep = (
        F.when(F.col("dtype") == "CLASS_DIAGRAM", is_class)
        .when(F.col("dtype") == "STATE_DIAGRAM", F.col("vertex") & F.col("label").isNotNull())
        .when(F.col("dtype") == "ER_DIAGRAM", F.col("vertex") & plain & ~(is_column_only(F.col("value")) & F.col("columns").isNull()))
        .when(F.col("dtype") == "ARCHITECTURE_DIAGRAM", F.col("vertex") & plain)
        .otherwise(plain & ~F.col("edge"))
    )
    kind = (
        F.when(F.col("dtype") == "CLASS_DIAGRAM", "class")
        .when(F.col("dtype") == "STATE_DIAGRAM", F.when(F.col("label") == "START", "state-start").when(F.col("label") == "END", "state-end").otherwise("state"))
        .when(F.col("dtype") == "ER_DIAGRAM", "table")
        .when(F.col("dtype") == "ARCHITECTURE_DIAGRAM", layer(F.col("label"), F.col("style")))
        .otherwise(style_type(F.col("style")))
    )
    none = F.array().cast("array<string>")
    members = lambda name: F.when(F.col("dtype") == "CLASS_DIAGRAM", F.coalesce(name, none)).otherwise(none)
    attributes = F.when(F.col("dtype") == "ER_DIAGRAM", F.coalesce("columns", none)).otherwise(members("attributes"))
    out = c.where(keep).select("diagram_id", "label", kind.alias("type"), "ord", attributes.alias("attributes"), members("methods").alias("methods"), members("stereotypes").alias("stereotypes"))
    return distinct_ordered(out, ["diagram_id", "label"], "ord")


def resolve_endpoints(cells: DataFrame, types: DataFrame, nodes: DataFrame) -> DataFrame:
    """(diagram_id, cell_id, node): for each cell the label of the nearest of itself and its parents that is a node of its diagram; in a
    diagram without nodes, that has a label at all (of a class diagram then none). Each round doubles the climb, so that the number of cells bounds the rounds; what is
    still open then are cells that are their own ancestors, which have no node."""
    any_node = nodes.select("diagram_id").distinct().withColumn("some", F.lit(True))
    named = nodes.select("diagram_id", F.col("label"), F.lit(True).alias("is_node"))
    c = _labelled(cells, types).join(any_node, "diagram_id", "left").join(named, ["diagram_id", "label"], "left")
    free = F.col("some").isNull() & (F.col("type") != "CLASS_DIAGRAM") & F.col("label").isNotNull()
    node = F.when(F.coalesce("is_node", F.lit(False)) | free, F.col("label"))
    climb = cut(c.select("diagram_id", "cell_id", "parent_id", node.alias("node")).where("cell_id is not null"))
    for _ in range(climb.count().bit_length() + 1):
        left = climb.where("node is null and parent_id is not null")
        if left.isEmpty():
            break
        up = climb.select("diagram_id", F.col("cell_id").alias("parent_id"), F.col("parent_id").alias("higher"), F.col("node").alias("found"))
        moved = left.join(up, ["diagram_id", "parent_id"]).select("diagram_id", "cell_id", F.col("higher").alias("parent_id"), F.col("found").alias("node"))
        climb = cut(climb.where("node is not null").unionByName(moved))
    return climb.where("node is not null").select("diagram_id", "cell_id", "node")


def edge_labels(cells: DataFrame) -> DataFrame:
    """(diagram_id, cell_id, edge_label): the texts of an edge and its children, each once, joined by blanks."""
    own = cells.where("edge").select("diagram_id", "cell_id", "value", F.lit(-1).alias("ord"))
    kids = cells.where("parent_id is not null").select("diagram_id", F.col("parent_id").alias("cell_id"), "value", "ord")
    first = distinct_ordered(own.unionAll(kids).where(is_meaningful(F.col("value"))), ["diagram_id", "cell_id", "value"], "ord")
    return first.groupBy("diagram_id", "cell_id").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), " ")).alias("edge_label"))


# Arrows and the relations that they stand for.
def relationship(style: Column) -> Column:
    """The kind of a class relation by its arrow."""
    low = F.lower(style)
    return (
        F.when(low.rlike("(start|end)arrow=block"), F.when(low.contains("dashed=1"), "implements").otherwise("extends"))
        .when(low.rlike("diamond=1|(start|end)arrow=diamond"), "aggregation")
        .when(low.contains("diamond=thin"), "composition")
        .when(low.contains("dashed=1"), "dependency")
        .otherwise("association")
    )


def multiplicity(label: Column) -> Column:
    """struct(summary, source, target) of the numbers at a relation's ends."""
    text, many, word = strip(F.coalesce(label, F.lit(""))), r"(?:1\.\.\*|0\.\.\*|\*|many)", r"(?:1|0\.\.1|1\.\.\*|0\.\.\*|\*|many|one)"
    one_many = text.rlike(rf"(?is)^(.*\b1\b.*{many}.*|.*{many}.*\b1\b.*)$")
    plain = text.rlike(rf"(?i)^{word}(\s*(to|:|-|\.\.)\s*{word})?$")
    spelled = F.replace(F.replace(F.replace(text, F.lit("1..*"), F.lit("one-to-many")), F.lit("0..*"), F.lit("zero-to-many")), F.lit("*"), F.lit("many"))
    row = lambda a, b, c: F.struct(a.alias("summary"), F.lit(b).alias("source"), F.lit(c).alias("target"))
    return F.when(one_many, row(F.lit("one-to-many"), "1", "many")).when(plain, row(spelled, "", "")).otherwise(row(F.lit(""), "", ""))


def diagram_edges(cells: DataFrame, types: DataFrame, nodes: DataFrame) -> DataFrame:
    """(diagram_id, source, target, label, relationship_type, source_multiplicity, target_multiplicity, ord): edges between nodes; loops
    and edges without both ends go, repeated ones stay once."""
    ends = resolve_endpoints(cells, types, nodes)
    at = lambda side: ends.select("diagram_id", F.col("cell_id").alias(f"{side}_id"), F.col("node").alias(side))
    e = cells.where("edge").join(types, "diagram_id").join(at("source"), ["diagram_id", "source_id"]).join(at("target"), ["diagram_id", "target_id"]).where("source <> target")
    e = e.join(edge_labels(cells), ["diagram_id", "cell_id"], "left").withColumn("m", multiplicity(F.col("edge_label"))).withColumn("arrow", relationship(F.col("style")))
    summary = F.col("m.summary")
    named = F.when((summary != "") & (F.col("arrow") == "association"), F.concat(summary, F.lit(" association"))).when(summary != "", F.concat(F.col("arrow"), F.lit(" "), summary)).otherwise(F.col("arrow"))
    is_class, is_er = F.col("type") == "CLASS_DIAGRAM", F.col("type") == "ER_DIAGRAM"
    label = F.when(is_class, named).when(is_er, F.coalesce(no_blank(F.col("edge_label")), F.lit("references"))).otherwise(no_blank(F.col("value")))
    out = e.select("diagram_id", "source", "target", label.alias("label"), F.when(is_class, F.col("arrow")).when(is_er, "reference").alias("relationship_type"), F.when(is_class, no_blank(F.col("m.source"))).alias("source_multiplicity"), F.when(is_class, no_blank(F.col("m.target"))).alias("target_multiplicity"), "ord")
    return distinct_ordered(out, ["diagram_id", "source", "relationship_type", "target", "label"], "ord")


def pick_diagram(candidates: DataFrame) -> DataFrame:
    """candidates(file_id, file_name, page_ix, diagram_name, labels, type) -> the best page of each file by how its name and labels meet
    the words of the file's name (three letters or more), first of equals."""
    plain = F.regexp_replace(F.lower(F.coalesce("file_name", F.lit(""))), "[^a-z0-9]+", " ")
    words = F.filter(F.split(plain, " "), lambda w: (F.length(w) >= 3) & ~w.isin("drawio", "png"))
    name, labels = F.lower(F.coalesce("diagram_name", F.lit(""))), F.lower(F.array_join("labels", " "))
    met = F.aggregate(words, F.lit(0), lambda s, w: s + F.when(F.contains(name, w), 12).otherwise(0) + F.when(F.contains(labels, w), 2).otherwise(0))
    kind = F.lit(0)
    for word, k in (("state", "STATE_DIAGRAM"), ("class", "CLASS_DIAGRAM"), ("arch", "ARCHITECTURE_DIAGRAM")):
        kind = kind + F.when(F.contains(plain, F.lit(word)) & (F.col("type") == k), 100).otherwise(0)
    w = Window.partitionBy("file_id").orderBy(F.desc("score"), "page_ix")
    return candidates.withColumn("score", met + kind).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def diagram_metadata(cells: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(diagram_id, label_count, node_count, edge_count, components, relationships)."""
    texts = lambda df, text, name: df.groupBy("diagram_id").agg(F.count("*").alias(f"{name}_count"), F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"]).alias(f"{name}_texts"))
    arrow = F.concat_ws(" -> ", "source", no_blank(F.col("label")), "target")
    labels = diagram_labels(cells).groupBy("diagram_id").agg(F.count("*").alias("label_count"))
    out = labels.join(texts(nodes, F.col("label"), "node"), "diagram_id", "left").join(texts(edges, arrow, "edge"), "diagram_id", "left")
    return out.fillna(0).withColumnsRenamed({"node_texts": "components", "edge_texts": "relationships"})


def valid_diagrams(types: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(diagram_id, valid): no raw ids, multiplicities or class attributes as nodes, and no repeated or open edges."""
    bad_node = is_raw_id(F.col("label")) | is_multiplicity(F.col("label")) | no_blank(F.col("label")).isNull()
    n = nodes.join(types.withColumnRenamed("type", "dtype"), "diagram_id").groupBy("diagram_id").agg(F.bool_or(bad_node | ((F.col("dtype") == "CLASS_DIAGRAM") & is_attribute(F.col("label")))).alias("bad_nodes"))
    key = F.concat_ws("\u0000", "source", F.coalesce("label", F.lit("")), "target")
    e = edges.groupBy("diagram_id").agg((F.bool_or(is_raw_id(F.col("source")) | is_raw_id(F.col("target"))) | (F.count("*") != F.countDistinct(key))).alias("bad_edges"))
    out = types.join(n, "diagram_id", "left").join(e, "diagram_id", "left")
    return out.select("diagram_id", (~F.coalesce("bad_nodes", F.lit(False)) & ~F.coalesce("bad_edges", F.lit(False))).alias("valid"))


def diagram_summary(types: DataFrame, cells: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(diagram_id, summary): a sentence for state, class and architecture diagrams, else one that lists the first twelve labels."""
    ordered = lambda cond, text: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", text.alias("t"))))), lambda x: x["t"]))
    rel = F.coalesce(no_blank(F.col("relationship_type")), F.col("label"), F.lit(""))
    e = edges.groupBy("diagram_id").agg(
        F.min_by("source", F.when(F.col("source") != "START", F.col("ord"))).alias("start"),
        F.slice(ordered(F.col("target") != "END", F.col("target")), 1, 4).alias("ends"),
        F.slice(ordered(rel.rlike("association|aggregation|composition"), F.concat_ws(" relates to ", "source", "target")), 1, 2).alias("uses"),
        F.slice(ordered(rel.rlike("extends|implements"), F.concat_ws(" ", "source", rel, "target")), 1, 2).alias("is_a"),
    )
    n = nodes.groupBy("diagram_id").agg(ordered(no_blank(F.col("type")).isNotNull(), F.col("type")).alias("kinds"))
    labels = diagram_labels(cells).groupBy("diagram_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]), 1, 12).alias("names"))
    out = types.join(e, "diagram_id", "left").join(n, "diagram_id", "left").join(labels, "diagram_id", "left")
    concise = F.when(F.size("names") > 0, F.concat(display_type(F.col("type")), F.lit(" containing: "), F.array_join("names", ", "), F.lit("."))).otherwise("Diagram structure could not be resolved reliably.")
    state = F.concat(F.lit("Workflow begins in "), F.col("start"), F.when(F.size("ends") > 0, F.concat(F.lit(" and can move to "), F.array_join("ends", ", "))).otherwise(""), F.lit("."))
    facts = F.concat("uses", "is_a")
    cls = F.when(F.size(facts) > 0, F.concat(F.array_join(facts, "; "), F.lit(".")))
    arch = F.when(F.size("kinds") > 0, F.concat(F.lit("Architecture diagram containing "), F.replace(F.array_join("kinds", ", "), F.lit("-"), F.lit(" ")), F.lit(".")))
    own = F.when(F.col("type") == "STATE_DIAGRAM", state).when(F.col("type") == "CLASS_DIAGRAM", cls).when(F.col("type") == "ARCHITECTURE_DIAGRAM", arch)
    return out.select("diagram_id", F.coalesce(own, concise).alias("summary"))


# Headings of an architecture diagram's layers, in their order.
LAYER_HEADINGS = (
    ("Inbound", "inbound"), ("Controller Layer", "controller-layer"), ("Core Business Services", "core-business-service"),
    ("Supporting Services", "supporting-service"), ("Cross-Cutting Services", "cross-cutting-service"), ("Domain Logic", "domain-logic"),
    ("Data Mapping", "data-mapping"), ("Data Access", "data-access"), ("Infrastructure", "infrastructure"),
    ("External Clients", "external-client"), ("Database", "database"),
)


def _table(rows: Column, head: str, columns: int) -> Column:
    """A pipe table of an array of ready lines; null where there is none."""
    rule = "|" + "---|" * columns
    return F.when(F.size(rows) > 0, F.concat(F.lit(f"{head}\n{rule}\n"), F.array_join(rows, "\n")))


def _titled(title: str, body: Column, colon: bool = False) -> Column:
    return F.when(no_blank(body).isNotNull(), F.concat(F.lit(f"{title}{':' if colon else ''}\n\n"), body))


def diagram_sections(types: DataFrame, cells: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(diagram_id, sections): summary, then tables of states and transitions, classes and relations, layers, or tables and references by
    the diagram's type, then all labels; diagrams that aren't valid give summary and labels only."""
    row = lambda *cols: F.concat(F.lit("| "), F.concat_ws(" | ", *[escape_cell(F.coalesce(c, F.lit(""))) for c in cols]), F.lit(" |"))
    lines = lambda text, cond=None: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.lit(True) if cond is None else cond, F.struct("ord", text.alias("t"))))), lambda x: x["t"]))
    members = F.array_join("attributes", "; ")
    abstract = F.when(F.exists("stereotypes", lambda x: F.lower(x).contains("abstract")), "Abstract class").otherwise("Class")
    bullet = F.concat(F.lit("- "), F.col("label"))
    n = nodes.groupBy("diagram_id").agg(
        lines(F.concat(F.lit("| "), escape_cell(F.col("label")), F.lit(" |  |"))).alias("states"),
        lines(row(F.col("label"), abstract, members)).alias("classes"),
        lines(row(F.col("label"), members)).alias("tables"),
        lines(bullet).alias("components"),
        *[F.slice(lines(bullet, F.col("type") == kind), 1, 40).alias(f"layer_{i}") for i, (_, kind) in enumerate(LAYER_HEADINGS)],
    )
    e = edges.groupBy("diagram_id").agg(
        lines(row(F.col("source"), F.col("label"), F.col("target"))).alias("moves"),
        lines(row(F.col("source"), F.coalesce(no_blank(F.col("label")), F.col("relationship_type"), F.lit("connects")), F.col("target"))).alias("relations"),
        lines(row(F.col("source"), F.col("target"), F.coalesce(no_blank(F.col("label")), F.lit("references")))).alias("references"),
        lines(F.concat(F.lit("- "), F.concat_ws(" -> ", "source", no_blank(F.col("label")), "target"))).alias("arrows"),
    )
    raw = diagram_labels(cells).where(~is_raw_id(F.col("label"))).groupBy("diagram_id").agg(F.slice(lines(bullet), 1, 200).alias("labels"))
    out = types.join(diagram_summary(types, cells, nodes, edges), "diagram_id").join(valid_diagrams(types, nodes, edges), "diagram_id")
    for part in (n, e, raw):
        out = out.join(part, "diagram_id", "left")
    listed = lambda c, k=None: F.array_join(F.col(c) if k is None else F.slice(c, 1, k), "\n")
    kinds = {
        "STATE_DIAGRAM": [_titled("Workflow Summary", F.col("summary"), True), _titled("States", _table(F.col("states"), "| State | Description |", 2)), _titled("Transitions", _table(F.col("moves"), "| From | Event | To |", 3))],
        "CLASS_DIAGRAM": [_titled("Domain Summary", F.col("summary"), True), _titled("Classes", _table(F.col("classes"), "| Class | Type | Attributes |", 3)), _titled("Relationships", _table(F.col("relations"), "| Source | Relationship | Target |", 3))],
        "ARCHITECTURE_DIAGRAM": [_titled("Architecture Summary", F.col("summary"), True), *[_titled(title, listed(f"layer_{i}"), True) for i, (title, _) in enumerate(LAYER_HEADINGS)]],
        "ER_DIAGRAM": [_titled("Data Model Summary", F.col("summary"), True), _titled("Tables", _table(F.col("tables"), "| Table | Columns |", 2)), _titled("Relationships", _table(F.col("references"), "| Source Table | Target Table | Join/Reference |", 3))],
    }
    body = F.concat_ws("\n\n", _titled("Diagram Summary", F.col("summary"), True), _titled("Key Labels", listed("labels", 20), True), _titled("Components", listed("components", 40), True), _titled("Relationships", listed("arrows", 40), True))
    for kind, parts in kinds.items():
        body = F.when(F.col("type") == kind, F.concat_ws("\n\n", *parts)).otherwise(body)
    poor = F.concat_ws("\n\n", _titled("Diagram Summary", F.col("summary"), True), _titled("Key Labels", listed("labels", 40), True))
    appendix = F.when(F.size("labels") > 0, F.concat(F.lit("<details>\n<summary>Raw extracted labels</summary>\n\n"), listed("labels"), F.lit("\n\n</details>")))
    return out.select("diagram_id", F.concat_ws("\n\n", F.when(F.col("valid"), body).otherwise(poor), appendix).alias("sections"))


def diagram_files(attachments: DataFrame) -> DataFrame:
    """(diagram_id, file_name, xml) of attachments(relative_path, content) that are diagram sources."""
    text, path = F.decode("content", "UTF-8"), F.col("relative_path")
    return attachments.where((extension(path) == "drawio") & is_drawio(text)).select(path.alias("diagram_id"), F.regexp_extract(path, r"([^/]*)$", 1).alias("file_name"), text.alias("xml"))


def choose_pages(files: DataFrame, pages: DataFrame, cells: DataFrame, types: DataFrame) -> DataFrame:
    """(diagram_id, file_id, page_ix, diagram_name, score): the page of each of files(diagram_id, file_name) that its name fits best; see pick_diagram."""
    labels = diagram_labels(cells).groupBy("diagram_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]).alias("labels"))
    names = files.select(F.col("diagram_id").cast("string").alias("file_id"), "file_name")
    rows = pages.join(names, "file_id").join(labels, "diagram_id", "left").join(types, "diagram_id", "left")
    rows = rows.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    return pick_diagram(rows).select("diagram_id", "file_id", "page_ix", "diagram_name", "score")


def analyze_diagrams(files: DataFrame) -> DataFrame:
    """(diagram_id, page_ix, diagram_name, type, valid, summary, sections, node_count, edge_count, label_count, components, relationships) of
    files(diagram_id, xml, file_name) in one call; without a file_name the diagram_id's last part stands for it.

    Of a file's pages the one that fits its name best is analysed, the first of equals; nodes and edges are made for that page only. Cells, types,
    nodes and edges are written once, since the parts read them several times. Files without a cell are generic, with zero counts and null lists.
    """
    if "file_name" not in files.columns:
        files = files.withColumn("file_name", F.regexp_extract(F.col("diagram_id").cast("string"), r"([^/]*)$", 1))
    whole = cut(diagram_cells(files))
    kinds = classify_diagrams(whole)
    pages = cut(choose_pages(files, diagram_pages(files), whole, kinds))
    cells = cut(whole.join(pages.select("diagram_id"), "diagram_id", "left_semi"))
    types = cut(pages.select("diagram_id").join(kinds, "diagram_id", "left").fillna("GENERIC_DIAGRAM", ["type"]))
    nodes = cut(diagram_nodes(cells, types))
    edges = cut(diagram_edges(cells, types, nodes))
    out = types.join(valid_diagrams(types, nodes, edges), "diagram_id").join(diagram_summary(types, cells, nodes, edges), "diagram_id")
    out = out.join(diagram_sections(types, cells, nodes, edges), "diagram_id").join(diagram_metadata(cells, nodes, edges), "diagram_id", "left")
    out = pages.drop("score").join(out, "diagram_id").drop("diagram_id").withColumnRenamed("file_id", "diagram_id")
    return out.fillna(0, ["node_count", "edge_count", "label_count"])
