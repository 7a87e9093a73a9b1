"""Page tables: triage, recognition results, running headers, warnings.

Pages are ``(doc_id, page_no, text, has_image)`` and results ``(doc_id, page_no, text,
confidence, languages, error)``. A document may hold any number of pages, so whatever is
per document is aggregated first and looked up per block of pages; page text itself is never
gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import ocrtext
from foliant.functions.script import GATHERED_SAMPLE, detect_script
from foliant.functions.text import round_exact, strip
from foliant.operators.ordering import BUCKET, bucket_of, first_rows, total_before
from foliant.operators.rows import each

SAMPLE_PAGES = 10
QUEUE_MIN_PAGES = 10
RUNNING_SHARE = 0.2
RUNNING_MIN_PAGES = 3
RUNNING_MIN_DOCUMENT = 5
PROBE_PAGES = 3
PROBE_BATCHES = 3
MIN_CONFIDENCE = 60.0
MAX_PAGES = 1000
LISTED_PAGES = 30

# Recogniser languages by script, and the full set read before it is known.
SCRIPT_LANGUAGES = {"uz-cyrl": "uzb_cyrl", "ru": "rus", "uz-latn": "uzb"}
ALL_LANGUAGES = "uzb+uzb_cyrl+rus"

# Warning texts.
WARN_FAILED = "OCR: %d ta sahifa o'qilmadi: %s"
WARN_LOW = "OCR: %d ta sahifa past ishonch bilan o'qildi (< %.0f%%): %s"
WARN_SPARSE = "%d-sahifada juda kam matn bor (%d belgi) — skanerlangan rasm bo'lishi mumkin."
WARN_UNAVAILABLE = "OCR ishlamadi, sahifalar matn qatlamidan olindi: %s"
WARN_NOTHING = "PDF ichidan matn topilmadi — hujjat skanerlangan va OCR talab qiladi."


def lookup_by_document(pages: DataFrame, per_doc: DataFrame, how: str = "left") -> DataFrame:
    """Join one row per document to its pages, block by block.

    ``per_doc`` carries ``_last_page``; its row is repeated once per block of pages, so no
    join key covers more than a block, however long the document is.
    """
    blocks = F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last_page") / BUCKET).cast("long"))
    spread = per_doc.withColumn("_block", F.explode(blocks)).drop("_last_page")
    return (
        pages.withColumn("_block", bucket_of("page_no"))
        .join(spread, ["doc_id", "_block"], how)
        .drop("_block")
    )


# -- triage -----------------------------------------------------------------------------------


def flag_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("needs_ocr", ocrtext.page_needs_ocr(F.col("text"), F.col("has_image")))


def sampled_pages(pages: DataFrame, size: int = SAMPLE_PAGES) -> DataFrame:
    """Page numbers spread evenly over each document, at most ``size``."""
    totals = pages.groupBy("doc_id").agg(F.max("page_no").alias("total"))
    count = F.least("total", F.lit(size))
    step = lambda i: F.rint(
        i * (F.col("total") - 1) / F.greatest(count - 1, F.lit(1))
    ).cast("int")
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), count - 1), step))
    return totals.where(F.col("total") > 0).select(
        "doc_id", "total", F.size(spots).alias("sampled"), F.explode(spots).alias("_spot")
    ).select("doc_id", "total", "sampled", (F.col("_spot") + 1).alias("page_no"))


def route_lanes(pages: DataFrame, forced: Column | None = None) -> DataFrame:
    """``ocr`` for documents that are estimated to need it on enough pages, else ``default``.

    The page test runs where the page is read; only its flag is joined to the sample.
    """
    flags = flag_pages(pages).select(
        "doc_id", "page_no", "needs_ocr",
        (forced if forced is not None else F.lit(False)).alias("forced"),
    )
    seen = sampled_pages(pages).join(flags, ["doc_id", "page_no"], "left")
    counts = seen.groupBy("doc_id", "total", "sampled").agg(
        F.count_if("needs_ocr").alias("needing"),
        F.coalesce(F.bool_or("forced"), F.lit(False)).alias("forced"),
    )
    estimate = F.col("needing") / F.col("sampled") * F.col("total")
    enough = estimate >= F.least(F.lit(QUEUE_MIN_PAGES), "total")
    return counts.select(
        "doc_id", "total", "sampled", "needing",
        F.when(F.col("forced") | enough, "ocr").otherwise("default").alias("lane"),
    )


def over_limit(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Documents that would need more pages recognised than allowed."""
    return (
        flag_pages(pages).groupBy("doc_id").agg(F.count_if("needs_ocr").alias("ocr_pages"))
        .where(F.col("ocr_pages") > max_pages)
    )


# -- running headers and page clean-up --------------------------------------------------------


def running_lines(
    pages: DataFrame, share: float = RUNNING_SHARE, min_pages: int = RUNNING_MIN_PAGES
) -> DataFrame:
    """Normalised first or last lines that repeat over a document: ``(doc_id, line, pages)``.

    Only pages with recognised text count, both as evidence and as the total.
    """
    return _running(pages, share, min_pages).select("doc_id", "line", "pages")


def _running(pages: DataFrame, share: float, min_pages: int) -> DataFrame:
    filled = pages.where(F.col("text") != "")
    # A page names its edge lines and, as NULL, itself, so one grouping counts lines and pages.
    named = F.concat(ocrtext.edge_candidates(F.col("text")), F.array(F.lit(None).cast("string")))
    counts = (
        each(filled, ["doc_id", "page_no"], named, "_at", "line")
        .groupBy("doc_id", "line").agg(
            F.count(F.lit(1)).alias("pages"), F.max("page_no").alias("_last"),
            F.bool_or(F.col("line").isNull()).alias("_whole"),
        )
    )
    # Tests of aggregates, which stay above the grouping, so that it is planned once.
    totals = counts.where("_whole").select(
        "doc_id", F.col("pages").alias("_total"), F.col("_last").alias("_last_page")
    )
    # The lower limit needs no total, so one-off lines stop here, before the join.
    repeated = counts.where(~F.col("_whole") & (F.col("pages") >= min_pages)).drop("_whole", "_last")
    enough = F.col("pages") >= F.col("_total") * share
    return repeated.join(totals, "doc_id").where(
        (F.col("_total") >= RUNNING_MIN_DOCUMENT) & enough
    )


def _with_running(pages: DataFrame) -> DataFrame:
    # A page names at most two lines and a running line is on a fifth of the pages, so a
    # document has at most ten of them.
    lines = _running(pages, RUNNING_SHARE, RUNNING_MIN_PAGES)
    per_doc = lines.groupBy("doc_id", "_last_page").agg(F.collect_set("line").alias("_running"))
    none = F.array().cast("array<string>")
    return lookup_by_document(pages, per_doc).withColumn("_running", F.coalesce("_running", none))


def peel_pages(pages: DataFrame) -> DataFrame:
    filled = pages.where(F.col("text") != "")
    return _with_running(filled).withColumn(
        "text", ocrtext.peel_edges(F.col("text"), F.col("_running"))
    ).drop("_running")


def clean_pages(pages: DataFrame) -> DataFrame:
    """Noise lines, page edges, mixed-script words, apostrophes, for pages with text."""
    filled = pages.where(F.col("text") != "")
    return _with_running(filled).withColumn(
        "text", ocrtext.clean_page(F.col("text"), F.col("_running"))
    ).drop("_running")


# -- recognition results ----------------------------------------------------------------------


def pages_todo(
    pages: DataFrame, results: DataFrame, dpi: int, forced: DataFrame | None = None
) -> DataFrame:
    """Pages without a reusable result: same resolution, no error.

    Stored results of the files in ``forced`` (``file_hash``) do not count: they are read anew.
    """
    if forced is not None:
        results = results.join(forced.select("file_hash").distinct(), "file_hash", "left_anti")
    done = results.where((F.col("dpi") == dpi) & F.col("error").isNull()).select(
        "file_hash", "page_no"
    )
    return pages.join(done, ["file_hash", "page_no"], "left_anti")


def merge_results(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store after a run: failed pages are not kept, a fresh result replaces a stored one.

    Of several fresh results of a page the one of the highest confidence stays.
    """
    key = ["file_hash", "dpi", "page_no"]
    rest = [c for c in fresh.columns if c not in key]
    first = sorted(rest, key=lambda c: c != "confidence")
    best = fresh.where(F.col("error").isNull()).groupBy(*key).agg(F.max(F.struct(*first)).alias("_best"))
    kept = best.select(*[F.col(c) if c in key else F.col(f"_best.{c}") for c in fresh.columns])
    return stored.join(kept.select(*key), key, "left_anti").unionByName(kept)


def overlay_ocr(layer: DataFrame, recognised: DataFrame) -> DataFrame:
    """Recognised text where there is any, else the text layer; ``from_ocr`` tells which.

    A page of white space alone has no text.
    """
    text = F.when(strip(F.col("text")) != "", F.col("text"))
    ocr = recognised.select("doc_id", "page_no", text.alias("_ocr"))
    base = layer.select("doc_id", "page_no", text.alias("_layer"))
    return (
        base.join(ocr, ["doc_id", "page_no"], "full_outer")
        .select(
            "doc_id", "page_no",
            F.coalesce("_ocr", "_layer").alias("text"),
            F.col("_ocr").isNotNull().alias("from_ocr"),
        )
        .where(F.col("text").isNotNull())
    )


def ocr_stats(results: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per document: pages, failures and the mean of page confidences over pages with text."""
    has_text = F.coalesce(F.col("text") != "", F.lit(False))
    return results.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(has_text).alias("pages_with_text"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if(has_text & (F.col("confidence") < min_confidence)).alias("low"),
        round_exact(F.avg(F.when(has_text, F.col("confidence"))), 1).alias("confidence"),
    )


def problem_pages(results: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(doc_id, page_no, problem)``: a page can be both failed and of low confidence."""
    low = F.coalesce(F.col("text") != "", F.lit(False)) & (F.col("confidence") < min_confidence)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("error").isNotNull(), "failed"), F.when(low, "low_confidence")
        )
    )
    return each(results, ["doc_id", "page_no"], kinds, "_at", "problem").drop("_at")


def page_lists(problems: DataFrame, limit: int = LISTED_PAGES) -> DataFrame:
    """Per document and problem: how many pages, and the first of them written out."""
    keys = ["doc_id", "problem"]
    counts = problems.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"))
    first = first_rows(
        problems, keys, [F.col("page_no")], bucket_of("page_no"), limit, "_rank"
    ).groupBy(*keys).agg(F.array_sort(F.collect_list("page_no")).alias("_shown"))
    return counts.join(first, keys).select(
        *keys, "pages", ocrtext.abbreviate(F.col("_shown"), F.col("pages"), limit).alias("listed")
    )


def page_facts(
    layer: DataFrame, results: DataFrame, min_confidence: float = MIN_CONFIDENCE,
    unavailable: bool = False,
) -> DataFrame:
    """One row per page of the text layer or the results: its final text and what became of it.

    ``text`` is the cleaned recognised text where there is any (``from_ocr``), else the text layer,
    else NULL. ``read`` tells that the page has a result, ``failed`` and ``low`` what is wrong with
    it, ``sparse`` the size of a thin text layer that was not read instead, ``in_layer`` whether
    the document's own pages hold it. The result's ``confidence``, ``languages`` and ``cached``
    stay, where its recogniser gave text; columns that ``results`` lack are NULL. Where the engine was ``unavailable``, ``results`` are
    the pages it should have read: they give no text and their layer is checked for being sparse.
    """
    own = strip(F.coalesce(F.col("text"), F.lit("")))
    pages = layer.select("doc_id", "page_no", own.alias("_layer"), F.lit(True).alias("_in"))
    has_text = F.coalesce(F.col("text") != "", F.lit(False))
    extra = ["languages", "cached"]
    known = {"confidence": "double", "error": "string", "languages": "string", "cached": "boolean"}
    results = results.withColumns({c: F.lit(None).cast(t) for c, t in known.items() if c not in results.columns})
    if unavailable:
        recognised = results.select(
            "doc_id", "page_no", F.lit("").alias("_clean"), F.lit(False).alias("_text"),
            F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("error"), *extra,
        )
    else:
        clean = F.when(has_text, ocrtext.clean_page(F.col("text"), F.col("_running"))).otherwise("")
        recognised = _with_running(results).select(
            "doc_id", "page_no", clean.alias("_clean"), has_text.alias("_text"), "confidence", "error", *extra
        )
    read = F.col("_text").isNotNull()
    from_ocr = F.coalesce(F.col("_clean") != "", F.lit(False))
    text = F.when(from_ocr, F.col("_clean")).when(F.col("_layer") != "", F.col("_layer"))
    given = F.coalesce("_text", F.lit(False))
    thin = (F.col("_layer") != "") & (F.length("_layer") < ocrtext.SPARSE_PAGE) & (~read | F.lit(unavailable))
    return pages.join(recognised, ["doc_id", "page_no"], "full_outer").select(
        "doc_id", "page_no", text.alias("text"), from_ocr.alias("from_ocr"), read.alias("read"),
        F.col("error").isNotNull().alias("failed"),
        F.coalesce(given & (F.col("confidence") < min_confidence), F.lit(False)).alias("low"),
        F.when(thin, F.length("_layer")).alias("sparse"),
        F.coalesce("_in", F.lit(False)).alias("in_layer"),
        F.when(given, F.col("confidence")).alias("confidence"), *extra,
    )


def page_warnings(
    facts: DataFrame, min_confidence: float = MIN_CONFIDENCE, unavailable: str | None = None
) -> DataFrame:
    """``(doc_id, kind_no, page_no, message)``; ordering by the first three is emission order.

    ``facts`` are read once. Pages are counted by document, kind and block of pages; a block
    passes on the first pages of a list that is cut, and all its sparse pages, each of which has a
    message of its own. When the engine was ``unavailable``, for the reason given, documents
    with pages to read are warned instead.
    """
    kinds = F.array_compact(F.array(
        F.lit(0),
        F.when(F.col("read") if unavailable is not None else F.col("failed"), 1),
        F.when(F.col("low") & F.lit(unavailable is None), 2),
        F.when(F.col("sparse").isNotNull(), 3),
    ))
    columns = ["doc_id", "page_no", "sparse", F.col("text").isNotNull().alias("filled"), "in_layer"]
    listed = F.array_sort(F.collect_list(F.when(F.col("kind") > 0, F.struct("page_no", "sparse"))))
    blocks = (
        each(facts, columns, kinds, "_at", "kind")
        .groupBy("doc_id", "kind", bucket_of("page_no").alias("block")).agg(
            F.count(F.lit(1)).alias("n"), F.bool_or("filled").alias("filled"),
            F.bool_or("in_layer").alias("in_layer"), listed.alias("pages"),
        )
        .withColumn("pages", F.when(F.col("kind") == 3, F.col("pages")).otherwise(F.slice("pages", 1, LISTED_PAGES)))
    )
    # Sparse pages stay in their blocks: there is nothing to bring together.
    whole = F.when(F.col("kind") == 3, F.col("block")).otherwise(0)
    documents = blocks.groupBy("doc_id", "kind", whole.alias("block")).agg(
        F.sum("n").alias("n"), F.bool_or("filled").alias("filled"), F.bool_or("in_layer").alias("in_layer"),
        F.array_sort(F.flatten(F.collect_list("pages"))).alias("pages"),
    )
    shown = F.transform(F.slice("pages", 1, LISTED_PAGES), lambda p: p["page_no"])
    pages = ocrtext.abbreviate(shown, F.col("n"), LISTED_PAGES)

    def one(kind_no: int, message: Column) -> Column:
        return F.array(F.struct(F.lit(kind_no).alias("kind_no"), F.lit(0).alias("page_no"), message.alias("message")))

    first = (
        F.format_string(WARN_FAILED, "n", pages) if unavailable is None
        else F.format_string(WARN_UNAVAILABLE, F.lit(unavailable))
    )
    sparse = F.transform("pages", lambda p: F.struct(
        F.lit(3).alias("kind_no"), p["page_no"].alias("page_no"),
        F.format_string(WARN_SPARSE, p["page_no"], p["sparse"]).alias("message"),
    ))
    messages = (
        F.when(F.col("kind") == 1, one(1, first))
        .when(F.col("kind") == 2, one(2, F.format_string(WARN_LOW, "n", F.lit(float(min_confidence)), pages)))
        .when(F.col("kind") == 3, sparse)
        .when(F.col("in_layer") & ~F.col("filled"), one(4, F.lit(WARN_NOTHING)))
    )
    return each(documents, ["doc_id"], messages, "_at", "_m").select("doc_id", "_m.*")


def recognition_stats(facts: DataFrame) -> DataFrame:
    """Per document with results: pages read, failed, low, from the store, and used instead of the layer.

    ``confidence`` is the mean of page confidences over pages with text. ``languages`` are those of
    the last page that was read anew, which is when they have been narrowed; NULL if none was.
    """
    fresh = F.when(~F.coalesce("cached", F.lit(False)), F.struct("page_no", "languages"))
    return facts.where("read").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("failed").alias("failed"), F.count_if("low").alias("low"),
        F.count_if(F.coalesce("cached", F.lit(False))).alias("cached"), F.count_if("from_ocr").alias("replaced"),
        round_exact(F.avg("confidence"), 1).alias("confidence"), F.max(fresh)["languages"].alias("languages"),
    )


def extraction_methods(overlaid: DataFrame) -> DataFrame:
    """``text``, ``ocr`` or ``mixed``: recognised pages against the number of chunks.

    Pages without text, which ``page_facts`` has as well, are no chunks.
    """
    overlaid = overlaid.where(F.col("text").isNotNull())
    ocr = F.col("ocr_pages")
    return (
        overlaid.groupBy("doc_id")
        .agg(F.count_if("from_ocr").alias("ocr_pages"), F.count(F.lit(1)).alias("chunks"))
        .withColumn(
            "extraction_method",
            F.when(ocr == 0, "text").when(ocr >= F.col("chunks"), "ocr").otherwise("mixed"),
        )
    )


def progress(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages recognised of all, per document, with the text shown while it runs."""
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    ready = done.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_done"))
    return (
        total.join(ready, "doc_id", "left")
        .withColumn("done", F.coalesce("_done", F.lit(0)).cast("long"))
        .withColumn("message", F.format_string("OCR: %d/%d sahifa", "done", "total"))
        .drop("_done")
    )


def probe_script(
    pages: DataFrame,
    fallback: str = ALL_LANGUAGES,
    probe_pages: int = PROBE_PAGES,
    batches: int = PROBE_BATCHES,
) -> DataFrame:
    """Which languages to read a document's remaining pages with, and how many pages it took.

    ``pages`` is ``(doc_id, page_no, text, cached)`` with each page's recognised text. Pages
    are read in batches; before each, the text so far (cached pages included, in page order)
    is tested for its script, and reading goes on with the full set only while it is unclear.
    A document with nothing left to read keeps the full set.

    Only the head of that text decides, so cached pages are kept up to that size and to-do
    pages up to the last probe: a bounded set per document.
    """
    page = bucket_of("page_no")
    text = F.coalesce(F.col("text"), F.lit(""))
    clipped = pages.select(
        "doc_id", "page_no", F.substring(text, 1, GATHERED_SAMPLE).alias("text"), "cached"
    )
    # Every page adds a space too, so at most GATHERED_SAMPLE cached pages pass.
    cached = total_before(
        clipped.where("cached"), ["doc_id"], [F.col("page_no")], page, F.length("text") + 1, "_at"
    ).where(F.col("_at") < GATHERED_SAMPLE)
    todo = first_rows(
        clipped.where("NOT cached"), ["doc_id"], [F.col("page_no")], page,
        probe_pages * batches, "rank",
    )
    waiting = pages.where("NOT cached").groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("todo")
    )
    used = cached.select("doc_id", "page_no", F.lit(0).alias("rank"), "text").unionByName(
        todo.select("doc_id", "page_no", "rank", "text")
    )
    gathered = used.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_no", "rank", "text"))).alias("pages")
    )

    def script_after(batch: int) -> Column:
        seen = F.filter("pages", lambda p: p["rank"] <= batch * probe_pages)
        joined = F.array_join(F.transform(seen, lambda p: p["text"]), " ")
        return detect_script(F.substring(joined, 1, GATHERED_SAMPLE))

    tries = F.array(*[
        F.struct(F.lit(b * probe_pages).alias("read"), script_after(b).alias("script"))
        for b in range(batches + 1)
    ])
    clear = F.get(F.filter(tries, lambda t: t["script"] != "other"), F.lit(0))
    language = F.lit(fallback)
    for name, languages in SCRIPT_LANGUAGES.items():
        language = F.when(F.col("_hit.script") == name, languages).otherwise(language)
    return (
        gathered.join(waiting, "doc_id", "left")
        .withColumn("_hit", F.when(F.col("todo") > 0, clear))
        .select(
            "doc_id",
            language.alias("language"),
            F.least(
                F.coalesce("_hit.read", F.lit(probe_pages * batches)),
                F.coalesce("todo", F.lit(0)),
            ).alias("pages_probed"),
        )
    )


def page_languages(pages: DataFrame, choice: DataFrame, fallback: str = ALL_LANGUAGES) -> DataFrame:
    """The language set each to-do page is read with: probed pages with all, later ones narrowed."""
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("_last_page"))
    todo = pages.where("NOT cached").select("doc_id", "page_no")
    probed = first_rows(
        todo, ["doc_id"], [F.col("page_no")], bucket_of("page_no"), PROBE_PAGES * PROBE_BATCHES,
        "_rank",
    )
    limits = probed.join(choice, "doc_id").groupBy("doc_id", "language").agg(
        F.max(F.when(F.col("_rank") <= F.col("pages_probed"), F.col("page_no"))).alias("_until")
    )
    return lookup_by_document(todo, limits.join(last, "doc_id"), "inner").select(
        "doc_id", "page_no",
        F.when(F.col("page_no") <= F.coalesce("_until", F.lit(0)), fallback)
        .otherwise(F.col("language")).alias("language"),
    )
