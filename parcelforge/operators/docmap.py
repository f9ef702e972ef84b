"""Document mapping: tokens to lines and cells, wire JSON to typed records, provenance to boxes.

Containment and overlap joins are equi joins on grid cells of a page; reads of several engines are
paired in rounds over their overlaps.  Clustering lines, whose order matters, works on one page at
a time in a grouped map; a page holds hundreds of tokens.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import areas, dates, numerals, shares, vocabulary
from ..session import shared_folder
from .plan import settled

# Overlap of equal reads, and what agreement does to confidence.
IOU, AGREE, DISAGREE, LEAST_CONFIDENCE, DEFAULT_CONFIDENCE, LINE_MATCH = 0.30, 1.10, 0.85, 0.30, 0.95, 72.0
TOKEN = "page string, text string, x0 double, y0 double, x1 double, y1 double, confidence double, engine string"


def kept_tokens(tokens: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    return tokens.filter((F.col("confidence") >= least) & (F.trim("text") != ""))


def box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Pixels to a box in 0..1, clamped and with its corners in order."""
    unit = lambda v, n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / n))
    xs, ys = [unit(x, width) for x in (x0, x1)], [unit(y, height) for y in (y0, y1)]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes given by column prefixes."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    size = lambda p: (c(p, "x1") - c(p, "x0")) * (c(p, "y1") - c(p, "y0"))
    return F.coalesce(F.try_divide(w * h, size(a) + size(b) - w * h), F.lit(0.0))


def overlapping(left: DataFrame, right: DataFrame, cell: float = 0.1) -> DataFrame:
    """Pairs on a page whose boxes meet: ``id_a, id_b, iou``; each pair once."""
    def spread(df: DataFrame, p: str) -> DataFrame:
        df = df.select(F.col("page").alias(f"{p}page"), F.col("id").alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")))
        at = lambda c: F.floor(F.col(f"{p}{c}") / cell)
        return df.withColumn(f"{p}gx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn(f"{p}gy", F.explode(F.sequence(at("y0"), at("y1"))))

    a, b = spread(left, "a_"), spread(right, "b_")
    home = (F.col("a_gx") == F.floor(F.greatest("a_x0", "b_x0") / cell)) & (F.col("a_gy") == F.floor(F.greatest("a_y0", "b_y0") / cell))
    j = a.join(b, (F.col("a_page") == F.col("b_page")) & (F.col("a_gx") == F.col("b_gx")) & (F.col("a_gy") == F.col("b_gy")) & home)
    return j.withColumn("iou", iou("a_", "b_")).filter("iou > 0").select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), "iou")


def _squeezed(text: Column) -> Column:
    """Without white space and case."""
    return F.replace(F.lower(F.regexp_replace(text, r"\s+", "")), F.lit("ß"), F.lit("ss"))


def engine_status(runs: DataFrame) -> DataFrame:
    """``page, engines, failed, status`` of reading runs ``page, engine, ok``: failed when no engine read the page, degraded when some did not, else whole."""
    out = runs.groupBy("page").agg(F.count(F.lit(1)).alias("engines"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == F.col("engines"), "failed").when(F.col("failed") > 0, "degraded").otherwise("whole"))


def greedy_pairs(edges: DataFrame) -> DataFrame:
    """``a, b`` of the sequential choice: each ``a`` in order of ``a_at`` takes the free ``b`` of greatest ``score``, the first by ``b_at`` of equals.

    ``edges``: ``a, b, a_at, b_at, score``. In rounds: an edge is taken when ``b`` is the best of its ``a``'s free partners and
    no earlier unpaired ``a`` has ``b`` among its own, since then no earlier choice can take it. The first
    unpaired ``a`` of every connected group is paired in each round, all groups at once; what meets in a task are the edges of one box.
    """
    shared_folder(edges.sparkSession)
    left, pairs = edges.checkpoint(), None
    by_a, by_b = Window.partitionBy("a").orderBy(F.desc("score"), "b_at"), Window.partitionBy("b").orderBy("a_at")
    while True:
        ranked = left.withColumns({"best": F.row_number().over(by_a), "turn": F.row_number().over(by_b)})
        taken = ranked.filter("best = 1 and turn = 1").select("a", "b").checkpoint()
        if taken.isEmpty():
            break
        pairs = taken if pairs is None else pairs.unionByName(taken)
        left = left.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti").checkpoint()
    return edges.select("a", "b").limit(0) if pairs is None else pairs


def reconcile(tokens: DataFrame, cell: float = 0.05) -> DataFrame:
    """Tokens of several engines as one set: overlapping reads are merged, others kept.

    The engine with most tokens on a page leads (the first of equals); each of its tokens, in order, takes the free token
    of greatest overlap above IOU, of equals that of the engine with more tokens, then the first. Order on a page is by ``seq`` if
    the tokens have it, else by height, place, engine and text.
    """
    names = tokens.columns
    order = ["seq"] if "seq" in names else ["y0", "x0", "x1", "y1", "engine", "text", "confidence"]
    rows = tokens.withColumn("__n", F.row_number().over(Window.partitionBy("page").orderBy(*order)))
    engines = rows.groupBy(F.col("page").alias("e_page"), F.col("engine").alias("e_engine")).agg(F.count(F.lit(1)).alias("n"), F.min("__n").alias("first"))
    engines = engines.withColumn("__rank", F.row_number().over(Window.partitionBy("e_page").orderBy(F.desc("n"), "first"))).drop("n", "first")
    shared_folder(tokens.sparkSession)
    rows = rows.join(engines, F.col("page").eqNullSafe(F.col("e_page")) & F.col("engine").eqNullSafe(F.col("e_engine"))).drop("e_page", "e_engine")
    rows = rows.withColumn("id", F.struct("page", "__rank", "__n")).checkpoint()
    base, others = rows.filter("__rank = 1"), rows.filter("__rank > 1")
    met = overlapping(base, others, cell).filter(F.col("iou") > IOU)
    edges = met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("id_a.__n").alias("a_at"), F.struct(F.col("id_b.__rank").alias("r"), F.col("id_b.__n").alias("n")).alias("b_at"), F.col("iou").alias("score"))
    pairs = greedy_pairs(edges)
    o = others.select(F.col("id").alias("o_id"), F.struct(*names).alias("o"))
    joined = base.select("id", F.struct(*names).alias("t")).join(pairs, F.col("id") == F.col("a"), "left").join(o, F.col("b") == F.col("o_id"), "left")
    t, x = (lambda n: F.col(f"t.{n}")), (lambda n: F.col(f"o.{n}"))
    lead = F.when(t("confidence") >= x("confidence"), F.col("t")).otherwise(F.col("o"))
    factor = F.when(_squeezed(t("text")) == _squeezed(x("text")), AGREE).otherwise(DISAGREE)
    merged = {"x0": F.least(t("x0"), x("x0")), "y0": F.least(t("y0"), x("y0")), "x1": F.greatest(t("x1"), x("x1")), "y1": F.greatest(t("y1"), x("y1")), "confidence": F.round(F.least(F.lit(1.0), lead["confidence"] * factor), 4), "engine": F.lit("ensemble")}
    alone = F.col("o_id").isNull()
    out = joined.select(*(F.when(alone, t(n)).otherwise(merged.get(n, lead[n])).alias(n) for n in names))
    return out.unionByName(others.join(pairs.select(F.col("b").alias("p_b")), F.col("id") == F.col("p_b"), "left_anti").select(names))


def lines(tokens: DataFrame) -> DataFrame:
    """Reading-order lines ``page, line, text, x0, y0, x1, y1, confidence``: a token joins the first line whose last token is near in height."""
    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(yc=(rows.y0 + rows.y1) / 2, h=(rows.y1 - rows.y0).clip(lower=1e-6)).sort_values(["yc", "x0"], kind="stable")
        found: list[list] = []
        for t in rows.itertuples():
            for line in found:
                last = line[-1]
                if abs(t.yc - last.yc) <= 0.6 * max(t.h, last.h):
                    line.append(t)
                    break
            else:
                found.append([t])
        found.sort(key=lambda g: min(t.y0 for t in g))
        out = [(g[0].page, k, " ".join(t.text for t in sorted(g, key=lambda t: t.x0)), min(t.x0 for t in g), min(t.y0 for t in g), max(t.x1 for t in g), max(t.y1 for t in g), min(t.confidence for t in g)) for k, g in enumerate(found)]
        return pd.DataFrame(out, columns=["page", "line", "text", "x0", "y0", "x1", "y1", "confidence"])

    return tokens.groupBy("page").applyInPandas(page, "page string, line int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")


def cell_texts(cells: DataFrame, tokens: DataFrame, grid: float = 0.1) -> DataFrame:
    """``page, row, col, text, confidence`` of cells (page, row, col, x0..y1) that own tokens: a token's centre lies inside, borders included."""
    at = lambda c: F.floor(c / grid)
    c = cells.withColumn("gx", F.explode(F.sequence(at(F.col("x0")), at(F.col("x1"))))).withColumn("gy", F.explode(F.sequence(at(F.col("y0")), at(F.col("y1")))))
    t = tokens.select(F.col("page").alias("t_page"), "text", "confidence", F.col("x0").alias("tx"), F.col("y0").alias("ty"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    inside = (F.col("cx") >= F.col("x0")) & (F.col("cx") <= F.col("x1")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") <= F.col("y1"))
    j = c.join(t, (F.col("page") == F.col("t_page")) & (F.col("gx") == at(F.col("cx"))) & (F.col("gy") == at(F.col("cy"))) & inside)
    owned = j.groupBy("page", "row", "col").agg(F.array_sort(F.collect_list(F.struct(F.round("ty", 3).alias("y"), F.col("tx").alias("x"), "text"))).alias("t"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return owned.select("page", "row", "col", F.trim(F.array_join("t.text", " ")).alias("text"), "confidence")


def markdown(cells: DataFrame) -> DataFrame:
    """One Markdown table per page from ``page, row, col, text``; the first row is the header."""
    rows = cells.groupBy("page", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")).alias("t")))).alias("c"))
    rows = rows.select("page", "row", F.concat(F.lit("| "), F.array_join("c.t", " | "), F.lit(" |")).alias("line"), F.size("c").alias("n"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("row", "line", "n"))).alias("r"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.get("r", F.lit(0))["n"]))
    return pages.select("page", F.array_join(F.concat(F.slice("r.line", 1, 1), F.array(rule), F.slice("r.line", 2, F.size("r"))), "\n").alias("table"))


def partial_ratio(a: str, b: str) -> float:
    """100 times the best ratio of the shorter text against windows of its length in the longer."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if not few:
        return 0.0
    if few in many:
        return 100.0
    n = len(few)
    matcher = SequenceMatcher(autojunk=False)
    matcher.set_seq2(few)
    best = 0.0
    for i in range(max(1, len(many) - n + 1)):
        matcher.set_seq1(many[i : i + n])
        if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best:
            best = max(best, matcher.ratio())
    return round(100 * best, 4)


@F.pandas_udf(T.DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def _bigrams(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, n, gram, times``: the pairs of neighbouring characters of a text, and its length ``n``."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)))
    grams = rows.select(*keys, F.length(text).alias("n"), F.explode(F.transform(places, lambda i: F.substring(F.col(text), i, F.lit(2)))).alias("gram"))
    return grams.groupBy(*keys, "n", "gram").agg(F.count(F.lit(1)).alias("times"))


def line_candidates(told: DataFrame, lines_: DataFrame, least: float = LINE_MATCH) -> DataFrame:
    """``document, path, page, line, bound`` of the pairs whose partial ratio can reach ``least``.

    A ratio of M matches in n characters has at most 2 (n - M) + 1 runs of matches, so at least
    3 M - 2 n - 1 pairs of neighbours are common to both texts: with s common ones M is at most
    (s + 2 n + 1) / 3.  Only texts of one and of four characters can reach it without a common pair; they meet all texts of
    their document.
    """
    left, right = _bigrams(told, ["document", "path"], "raw_text"), _bigrams(lines_, ["document", "page", "line"], "line_text")
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    both = left.join(right, (F.col("document") == F.col("r_document")) & (F.col("gram") == F.col("r_gram")))
    n = F.least("n", "r_n")
    both = both.groupBy("document", "path", F.col("r_page").alias("page"), F.col("r_line").alias("line"), n.alias("n")).agg(F.sum(F.least("times", "r_times")).alias("s"))
    bound = F.least(F.lit(1.0), F.floor((F.col("s") + 2 * F.col("n") + 1) / 3) / F.col("n")) * 100
    pairs = both.filter(~F.col("n").isin(1, 4)).withColumn("bound", bound).filter(F.col("bound") >= least).select("document", "path", "page", "line", "bound")
    short = lambda c: F.length(c).isin(1, 4)
    texts = lines_.select(F.col("document").alias("r_document"), "page", "line", F.length("line_text").alias("r_n"))
    few = lambda a, b: a.select("document", "path", F.length("raw_text").alias("n")).join(b, F.col("document") == F.col("r_document")).filter(F.least("n", "r_n").isin(1, 4))
    some = few(told.filter(short("raw_text")), texts).unionByName(few(told.filter(~short("raw_text")), texts.filter(F.col("r_n").isin(1, 4))))
    return pairs.unionByName(some.select("document", "path", "page", "line", F.lit(100.0).alias("bound")))


def attach_boxes(provenance: DataFrame, page_lines: DataFrame) -> DataFrame:
    """``document, path, raw_text`` with the box of the first best-matching line (by page and line) of the document, if it reaches LINE_MATCH.

    Each text is measured against the line of greatest bound first; then only against lines whose bound is no less than
    what that one reached.  ``score`` is null where no line can reach LINE_MATCH; paths are unique in a document.
    """
    lines_ = page_lines.select("document", "page", "line", F.col("text").alias("line_text"), F.struct("x0", "y0", "x1", "y1").alias("box")).filter(F.trim(F.coalesce("line_text", F.lit(""))) != "")
    told = provenance.filter(F.trim(F.coalesce("raw_text", F.lit(""))) != "").select("document", "path", "raw_text")
    shared_folder(provenance.sparkSession)
    pairs = line_candidates(told, lines_).checkpoint()

    def measured(some: DataFrame) -> DataFrame:
        score = partial_ratio_udf("raw_text", "line_text")
        return some.select("document", "path", "page", "line").join(told, ["document", "path"]).join(lines_, ["document", "page", "line"]).select("document", "path", "page", "line", "box", score.alias("score"))

    place = F.struct((-F.col("bound")).alias("b"), "page", "line")
    first = pairs.groupBy("document", "path").agg(F.min(place).alias("p")).select("document", "path", F.col("p.page").alias("page"), F.col("p.line").alias("line"))
    first = measured(first).checkpoint()
    reached = first.select(F.col("document").alias("f_document"), F.col("path").alias("f_path"), F.col("page").alias("f_page"), F.col("line").alias("f_line"), F.greatest("score", F.lit(LINE_MATCH)).alias("reached"))
    left = pairs.join(reached, (F.col("document") == F.col("f_document")) & (F.col("path") == F.col("f_path")))
    left = left.filter((F.col("bound") >= F.col("reached")) & ((F.col("page") != F.col("f_page")) | (F.col("line") != F.col("f_line"))))
    hits = first.unionByName(measured(left))
    best = hits.groupBy(F.col("document").alias("b_document"), F.col("path").alias("b_path")).agg(F.min_by(F.struct("box", "score"), F.struct((-F.col("score")).alias("s"), "page", "line")).alias("hit"))
    out = provenance.join(best, (F.col("document") == F.col("b_document")) & (F.col("path") == F.col("b_path")), "left")
    return out.select(*provenance.columns, F.when(F.col("hit.score") >= LINE_MATCH, F.col("hit.box")).alias("box"), F.col("hit.score").alias("score"))

# Wire JSON

# Unit fields of an area.
UNITS = ("hectare", "are", "sq_metre", "acre", "guntha", "kanal", "marla", "bigha", "biswa", "biswansi")
_W_AREA = "struct<raw_text:string," + ",".join(f"{u}:string" for u in UNITS) + ">"
_W_PERSON = "struct<raw_name:string,transliterated:string,relation_raw:string,relation_name:string>"
WIRE = (
    "detected_record_format string, parcels array<struct<survey_number:string,khata_number:string,khasra_numbers:array<string>,assessment_amount:string,water_rate:string,total_area:" + _W_AREA + ","
    "jurisdiction:struct<state:string,district:string,tehsil:string,village:string>,"
    "sub_divisions:array<struct<sub_division_number:string,area:" + _W_AREA + ",classification_raw:string,assessment_amount:string,owner_serial_numbers:array<string>,remarks:string>>,"
    "classified_areas:array<struct<raw_label:string,area:" + _W_AREA + ",irrigation_raw:string>>,"
    "crops:array<struct<year:string,season_raw:string,crop_name:string,area:" + _W_AREA + ",irrigation_raw:string,remarks:string>>,"
    "owners:array<struct<serial_number:string,name:" + _W_PERSON + ",tenure_raw:string,share:struct<raw_text:string,numerator:string,denominator:string>>>,"
    "mutations:array<struct<mutation_number:string,type_raw:string,status_raw:string,entry_date_raw:string,order_date_raw:string,to_parties:array<" + _W_PERSON + ">,area_transacted:" + _W_AREA + ">>,"
    "encumbrances:array<struct<type_raw:string,status_raw:string,holder_name:string,discharged_on_raw:string>>>>, "
    "field_confidences array<struct<field_path:string,confidence:double,reason:string>>"
)


def read_wire(rows: DataFrame, json: str = "json") -> DataFrame:
    """``document, wire, corrupt``: the transcription as a struct; text that does not parse is set apart, not fatal."""
    parsed = F.from_json(F.col(json), f"{WIRE}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.withColumn("wire", parsed).withColumn("corrupt", F.col("wire._corrupt_record").isNotNull() | F.col("wire").isNull())


def repaired(json: Column) -> Column:
    """JSON as models often wrap it: what lies outside the outermost braces goes, and so do commas before a closing bracket."""
    inner = F.regexp_extract(json, r"(?s)(\{.*\})", 1)
    return F.nullif(F.regexp_replace(inner, r",\s*([}\]])", "$1"), F.lit(""))


def validated(rows: DataFrame, schema: str, json: str = "json") -> DataFrame:
    """Rows with ``record`` (null if unreadable) and ``state``: valid, repaired or rejected. A second reading follows a repair, and none after that."""
    read = lambda c: F.from_json(c, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = settled(rows.withColumn("__first", read(F.col(json))))
    good = F.col("__first").isNotNull() & F.col("__first._bad").isNull()
    rows = settled(rows.withColumn("__second", F.when(~good, read(repaired(F.col(json))))))
    again = F.col("__second").isNotNull() & F.col("__second._bad").isNull()
    record = F.when(good, F.col("__first")).when(again, F.col("__second")).dropFields("_bad")
    return rows.withColumns({"record": record, "state": F.when(good, "valid").when(again, "repaired").otherwise("rejected")}).drop("__first", "__second")


def owners(parcels: DataFrame) -> DataFrame:
    """One row per owner of ``document, parcel, p`` rows: nameless rows are dropped with a warning, equal-share markers leave the share open."""
    o = parcels.select("document", "parcel", F.posexplode("p.owners").alias("i", "o"))
    named = F.trim(F.coalesce("o.name.raw_name", F.lit(""))) != ""
    o = o.withColumns({"tenure": vocabulary.resolve(F.col("o.tenure_raw"), "tenure"), "relation": vocabulary.resolve(F.col("o.name.relation_raw"), "relation")})
    share = F.when(~shares.is_equal_marker(F.col("o.share.raw_text")), shares.parse(F.col("o.share.raw_text"), F.col("o.share.numerator"), F.col("o.share.denominator")))
    path = F.concat(F.lit("$.parcels["), F.col("parcel").cast("string"), F.lit("].owners["), F.col("i").cast("string"), F.lit("]"))
    return o.select("document", "parcel", "i", path.alias("path"), F.col("o.serial_number").alias("serial_number"), F.col("o.name.raw_name").alias("name"), F.col("relation.value").alias("relation"), F.col("tenure.value").alias("tenure"), share.alias("share"), F.when(~named, "no name").when(F.col("o.tenure_raw").isNotNull() & ~F.col("tenure.resolved"), "unresolved tenure").alias("warning"), named.alias("kept"))


def mutations(parcels: DataFrame) -> DataFrame:
    """One row per mutation; an order before its entry is dropped with a warning."""
    m = parcels.select("document", "parcel", F.posexplode("p.mutations").alias("i", "m"))
    m = m.withColumns({"entry_date": dates.parse(F.col("m.entry_date_raw")), "order_date": dates.parse(F.col("m.order_date_raw")), "kind": vocabulary.resolve(F.col("m.type_raw"), "mutation_type"), "state": vocabulary.resolve(F.col("m.status_raw"), "mutation_status")})
    backwards = F.coalesce(F.col("order_date") < F.col("entry_date"), F.lit(False))
    return m.select("document", "parcel", "i", F.col("m.mutation_number").alias("number"), F.col("kind.value").alias("mutation_type"), F.col("state.value").alias("status"), "entry_date", "order_date", F.when(backwards, "order before entry").when(F.col("m.type_raw").isNotNull() & ~F.col("kind.resolved"), "unresolved type").alias("warning"), (~backwards).alias("kept"))


def encumbrances(parcels: DataFrame) -> DataFrame:
    """One row per charge; a date of discharge means discharged."""
    e = parcels.select("document", "parcel", F.posexplode("p.encumbrances").alias("i", "e"))
    gone = dates.parse(F.col("e.discharged_on_raw")).isNotNull()
    return e.select("document", "parcel", "i", vocabulary.resolve(F.col("e.type_raw"), "encumbrance_type")["value"].alias("encumbrance_type"), F.when(gone, "discharged").otherwise(vocabulary.resolve(F.col("e.status_raw"), "encumbrance_status")["value"]).alias("status"), F.col("e.holder_name").alias("holder_name"))


def _area_of(rows: DataFrame, area: str, path: Column) -> DataFrame:
    """Rows with ``sq_metre`` and ``warning``: an area that states something unreadable is as absent as none, but says so."""
    stated = F.exists(F.array(*(F.col(f"{area}.{f}") for f in ("raw_text", *UNITS))), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    rows = rows.withColumns({"path": path, "sq_metre": wire_area(F.col(area), F.col("system"))["sq_metre"]})
    return rows.withColumn("warning", F.when(F.col("sq_metre").isNotNull(), F.lit(None).cast("string")).when(stated, "unreadable area").otherwise("no area"))


def _place(field: str) -> Column:
    return F.concat(F.lit("$.parcels["), F.col("parcel").cast("string"), F.lit(f"].{field}["), F.col("i").cast("string"), F.lit("]"))


def classified_areas(parcels: DataFrame) -> DataFrame:
    """One row per classified area: without an area it is not kept; an unknown label stays with a warning and class ``unknown``."""
    c = _area_of(parcels.select("document", "parcel", "system", F.posexplode("p.classified_areas").alias("i", "c")), "c.area", _place("classified_areas"))
    c = settled(c.withColumns({"class": vocabulary.resolve(F.col("c.raw_label"), "classification"), "water": vocabulary.resolve(F.col("c.irrigation_raw"), "irrigation")}))
    unknown = (F.trim(F.coalesce("c.raw_label", F.lit(""))) != "") & ~F.col("class.resolved")
    kept = F.col("sq_metre").isNotNull()
    return c.select("document", "parcel", "i", "path", F.col("c.raw_label").alias("raw_label"), F.col("class.value").alias("classification"), F.col("water.value").alias("irrigation"), "sq_metre", F.coalesce("warning", F.when(unknown, "unresolved classification")).alias("warning"), kept.alias("kept"))


def sub_divisions(parcels: DataFrame) -> DataFrame:
    """One row per sub-division: without an area it is not kept, without a number it is called by its place; money is a decimal with look-alikes repaired."""
    s = _area_of(parcels.select("document", "parcel", "system", F.posexplode("p.sub_divisions").alias("i", "s")), "s.area", _place("sub_divisions"))
    number = F.coalesce(F.nullif(F.col("s.sub_division_number"), F.lit("")), F.concat(F.lit("unnumbered-"), F.col("i").cast("string")))
    return s.select("document", "parcel", "i", "path", number.alias("number"), vocabulary.resolve(F.col("s.classification_raw"), "classification")["value"].alias("classification"), "sq_metre", numerals.decimal_of(F.col("s.assessment_amount"), True).alias("assessment"), F.coalesce("s.owner_serial_numbers", F.array().cast("array<string>")).alias("owner_serial_numbers"), F.col("s.remarks").alias("remarks"), "warning", F.col("sq_metre").isNotNull().alias("kept"))


def crops(parcels: DataFrame) -> DataFrame:
    """One row per crop, all kept; its area may be absent."""
    c = _area_of(parcels.select("document", "parcel", "system", F.posexplode("p.crops").alias("i", "c")), "c.area", _place("crops"))
    return c.select("document", "parcel", "i", F.col("c.year").alias("year"), F.col("c.season_raw").alias("season"), F.col("c.crop_name").alias("crop"), "sq_metre", vocabulary.resolve(F.col("c.irrigation_raw"), "irrigation")["value"].alias("irrigation"), F.col("c.remarks").alias("remarks"), F.when(F.col("warning") == "unreadable area", F.col("warning")).alias("warning"))


def assessments(parcels: DataFrame) -> DataFrame:
    """``document, parcel, assessment, water_rate``: a parcel's money as decimals with look-alikes repaired, null where it says none."""
    return parcels.select("document", "parcel", *(numerals.decimal_of(F.col(f"p.{f}"), True).alias(n) for f, n in (("assessment_amount", "assessment"), ("water_rate", "water_rate"))))


def wire_area(area: Column, system: Column, region: Column | None = None) -> Column:
    """Area of a transcription: its filled components if there are any (look-alikes repaired), else its text."""
    none = F.lit(None).cast("string")
    word = {"sq_metre": "sqm"}
    parts = F.filter(F.array(*(F.when(numerals.decimal_of(area[u], True).isNotNull(), F.concat(numerals.decimal_of(area[u], True).cast("string"), F.lit(f" {word.get(u, u)}"))) for u in UNITS)), lambda x: x.isNotNull())
    text = F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(area["raw_text"])
    return areas.parse(text, system, none if region is None else region)


def parcels(wire: DataFrame) -> DataFrame:
    """``document, parcel, p, system`` for every parcel of readable transcriptions; a damaged document costs no other."""
    ok = wire.filter(~F.col("corrupt"))
    return ok.select("document", areas.system_for_format(F.col("wire.detected_record_format")).alias("system"), F.posexplode("wire.parcels").alias("parcel", "p"))


def field_confidence(wire: DataFrame, paths: DataFrame) -> DataFrame:
    """Confidence of each ``document, path``: what the transcription flagged, else the default."""
    flagged = wire.select(F.col("document").alias("d"), F.explode("wire.field_confidences").alias("f")).groupBy("d", F.col("f.field_path").alias("f_path")).agg(F.first("f.confidence").alias("c"))
    j = paths.join(flagged, (F.col("document") == F.col("d")) & (F.col("path") == F.col("f_path")), "left")
    return j.select(*paths.columns, F.coalesce("c", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"))


# Bundles from loose documents

# Short forms of document types, and labels of printed certificates.
TYPE_ALIASES = {
    "ror": "jamabandi", "record_of_rights": "jamabandi", "old_jamabandi": "jamabandi", "previous_jamabandi": "jamabandi", "updated_ror": "updated_jamabandi", "new_jamabandi": "updated_jamabandi",
    "mutation": "mutation_order", "intekal": "mutation_order", "ferfar": "mutation_order", "legal_heir": "legal_heir_certificate", "heir_certificate": "legal_heir_certificate", "family_details": "family_register",
    "release_deed": "relinquishment_deed", "relinquishment": "relinquishment_deed", "haq_tyag": "relinquishment_deed", "partition": "partition_deed", "settlement": "family_settlement", "decree": "court_order",
}
TYPES = ("jamabandi", "updated_jamabandi", "death_certificate", "legal_heir_certificate", "family_register", "mutation_order", "mutation_application", "will", "relinquishment_deed", "partition_deed", "family_settlement", "court_order", "succession_certificate", "other")
LABELS = {
    "name": ("name of the deceased", "name of deceased", "deceased name", "मृतक का नाम", "name"),
    "date_of_death": ("date of death", "मृत्यु की तिथि", "मृत्यू दिनांक", "date of the death"),
    "registration_number": ("registration no", "registration number", "reg no", "पंजीकरण संख्या"),
    "place": ("place of death", "मृत्यु का स्थान", "place"),
    "issuing_authority": ("issued by", "registrar", "issuing authority"),
}
HEIR_LABELS = ("wife", "husband", "son", "daughter", "widow", "mother", "father", "पत्नी", "पति", "पुत्र", "पुत्री", "विधवा", "मुलगा", "मुलगी")


def document_type(raw: Column) -> Column:
    """The closed type of a discriminator; unknown ones are other."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "[- ]", "_")
    table = F.create_map(*(x for a, b in TYPE_ALIASES.items() for x in (F.lit(a), F.lit(b))))
    return F.coalesce(F.try_element_at(table, text), F.when(text.isin(*TYPES), text), F.lit("other"))


def route(kind: Column) -> Column:
    """Which part of a case a document becomes."""
    return (
        F.when(kind.isin("jamabandi", "updated_jamabandi"), "snapshot").when(kind == "death_certificate", "death").when(kind.isin("legal_heir_certificate", "family_register"), "heirs")
        .when(kind.isin("mutation_order", "mutation_application"), "mutation").otherwise("supporting")
    )


def labelled_fields(text: Column) -> Column:
    """STRUCT<fields map, heirs array<struct<relation, name>>> of the lines ``label : value`` of a certificate; the first line of a field wins."""
    pairs = F.transform(F.filter(F.split(text, r"[\r\n]+"), lambda x: x.rlike(r"^\s*[^:：]{2,40}\s*[:：]\s*\S")), lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^\s*([^:：]{2,40}?)\s*[:：]", 1))).alias("key"), F.trim(F.regexp_extract(x, r"[:：]\s*(.+?)\s*$", 1)).alias("value")))

    def kinds(key: Column) -> Column:
        """Fields whose labels occur in the key, in order of precedence."""
        hits = [F.when(_any(key, labels), F.lit(name)) for name, labels in LABELS.items()]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    start = F.struct(F.create_map().cast("map<string,string>").alias("fields"), F.array().cast("array<struct<relation:string,name:string>>").alias("heirs"))

    def take(s: Column, p: Column) -> Column:
        free = F.get(F.filter(kinds(p["key"]), lambda n: ~F.map_contains_key(s["fields"], n)), F.lit(0))
        relation = F.get(F.filter(F.array(*(F.lit(x) for x in HEIR_LABELS)), lambda r: F.contains(p["key"], r)), F.lit(0))
        field = F.struct(F.map_concat(s["fields"], F.create_map(F.coalesce(free, F.lit("")), p["value"])).alias("fields"), s["heirs"].alias("heirs"))
        heir = F.struct(s["fields"].alias("fields"), F.array_append(s["heirs"], F.struct(relation.alias("relation"), p["value"].alias("name"))).alias("heirs"))
        return F.when(free.isNotNull(), field).when(relation.isNotNull(), heir).otherwise(s)

    return F.aggregate(pairs, start, take)


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = None
    for p in parts:
        one = F.contains(text, F.lit(p))
        out = one if out is None else out | one
    return out


def text_confidence(found: Column, kind: Column) -> Column:
    """Share of the needed fields that were found; half without heirs on an heir certificate."""
    has = lambda n: F.map_contains_key(found["fields"], F.lit(n)).cast("int")
    death = (has("name") + has("date_of_death")) / 2
    heirs = has("name") * F.when((kind == "legal_heir_certificate") & (F.size(found["heirs"]) == 0), 0.5).otherwise(1.0)
    return F.when(kind == "death_certificate", death).otherwise(heirs)


# Paths into JSON


def without_computed(record: Column, *fields: str) -> Column:
    """A record without the fields that are computed anew on reading."""
    return record.dropFields(*fields)


def read_path(json: Column, path: Column | str) -> Column:
    """The value at a path as text, null where the path leads nowhere."""
    return F.get_json_object(json, path)


@F.pandas_udf(T.StringType())
def write_path(json: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    """JSON text with the value (JSON text too) at an existing parent's path; null when the parent is missing."""
    import json as j
    import re

    out = []
    for doc, p, v in zip(json, path, value, strict=True):
        steps = [int(b) if b else a for a, b in re.findall(r"\.([^.\[\]]+)|\[(\d+)\]", p or "")]
        try:
            root = j.loads(doc)
            at = root
            for s in steps[:-1]:
                at = at[s]
            if isinstance(steps[-1], int):
                at[steps[-1]]  # the place must exist
            elif not isinstance(at, dict):
                raise KeyError(steps[-1])
            at[steps[-1]] = j.loads(v)
            out.append(j.dumps(root, ensure_ascii=False))
        except (TypeError, ValueError, KeyError, IndexError):
            out.append(None)
    return pd.Series(out, dtype=object)
