"""Documents whose whole text is one cell: everything is row-local, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import grounding
from foliant.functions.nfc import nfc
from foliant.functions.script import CAPS_MARK, detect_script, latin_if_uzbek, script_sample
from foliant.functions.text import let, strip
from foliant.functions.typography import repair_typography
from foliant.operators.sections import markdown_sections_of, parts_of

# Fixed value: why a document without sections fails.
NO_CONTENT = "Hujjatdan matn ajratib bo'lmadi — indekslash uchun kontent yo'q."

# A noncharacter between sections that are repaired as one text. No step sees a letter or space in it.
SECTION_BREAK = "\ufdd1"


def finished_texts(texts: Column, script: Column) -> Column:
    """Texts of sections, repaired and in Latin where due, as one text with breaks in between.

    A document may have very many short sections, and each step costs more to begin than it takes on one
    of them. Sections whose own text holds one of the two noncharacters are finished one by one.
    """

    def split(joined: Column) -> Column:
        # Only what is left of a section after its characters of no width may have spaces at the ends.
        return F.transform(F.split(joined, SECTION_BREAK), strip)

    def together(joined: Column) -> Column:
        return let(
            split(repair_typography(joined)),
            lambda done: F.when(
                script == "uz-cyrl",
                F.split(latin_if_uzbek(F.array_join(done, SECTION_BREAK), script), SECTION_BREAK),
            ).otherwise(done),
        )

    apart = F.transform(texts, lambda text: latin_if_uzbek(repair_typography(text), script))
    marked = F.exists(
        texts, lambda text: F.contains(text, F.lit(SECTION_BREAK)) | F.contains(text, F.lit(CAPS_MARK))
    )
    return F.when(F.size(texts) == 0, texts).when(marked, apart).otherwise(
        let(F.array_join(texts, SECTION_BREAK), together)
    )


def process_sections(documents: DataFrame, kind: str = "part") -> DataFrame:
    """Add ``sections`` (cleaned, in Latin where due) and ``script`` to ``documents``.

    ``kind`` says how ``text`` is cut: ``part`` for plain text, ``section`` for Markdown.
    The script is decided on the raw sections. NFC does not move section bounds, so it is
    applied to the whole text, outside the lambda that repairs the sections.
    """
    cut = parts_of if kind == "part" else markdown_sections_of

    def finish(state: Column) -> Column:
        script = detect_script(script_sample(F.transform(state["raw"], lambda s: s["text"])))
        texts = F.transform(state["cut"], lambda s: s["text"])

        def labelled(done: Column) -> Column:
            return F.zip_with(
                state["cut"], done, lambda s, text: F.struct(s["label"].alias("label"), text.alias("text"))
            )

        return let(
            script,
            lambda decided: F.struct(
                decided.alias("script"), let(finished_texts(texts, decided), labelled).alias("sections")
            ),
        )

    def cut_both(state: Column) -> Column:
        # Text that NFC leaves alone is cut once.
        other = F.when(state["nfc"] != state["text"], cut(state["nfc"]))
        return let(
            F.struct(cut(state["text"]).alias("raw"), other.alias("other")),
            lambda s: let(
                F.struct(s["raw"].alias("raw"), F.coalesce(s["other"], s["raw"]).alias("cut")),
                finish,
            ),
        )

    both = F.struct(F.col("text").alias("text"), nfc(F.col("text")).alias("nfc"))
    return documents.withColumn("_done", let(both, cut_both)).select(
        *documents.columns, "_done.script", "_done.sections"
    )


def ground(documents: DataFrame, kind: str = "part") -> DataFrame:
    """Whole grounded Markdown per document.

    ``documents`` carries ``material_id``, ``text`` and the metadata columns ``module_code``,
    ``module_name``, ``topic_code``, ``topic_name``, ``type``, ``original_filename``.
    Documents without a section come back as ``failed`` with the reason.
    """
    name, topic, what = F.col("original_filename"), F.col("topic_code"), F.col("type")

    def block(section: Column, fields: Column) -> Column:
        marker = grounding.marker_of(
            fields["file"], grounding.marker_field(section["label"]), fields["topic"], fields["kind"]
        )
        return let(
            F.struct(marker.alias("marker"), grounding.split_for_grounding(section["text"]).alias("segments")),
            lambda s: F.struct(
                grounding.section_block(section["label"], s["marker"], s["segments"]).alias("text"),
                grounding.marker_count(s["segments"]).alias("markers"),
            ),
        )

    # What all markers of a document have in common is made once.
    fields = F.struct(
        grounding.marker_field(name).alias("file"), grounding.marker_field(topic).alias("topic"),
        grounding.marker_field(what).alias("kind"),
    )
    all_blocks = let(fields, lambda f: F.transform("sections", lambda s: block(s, f)))

    head = grounding.frontmatter(
        {
            "module_id": F.col("module_code"),
            "module_name": F.col("module_name"),
            "topic_id": topic,
            "topic_name": F.col("topic_name"),
            "type": what,
            "source": name,
            "script": F.col("script"),
        },
        F.size("sections"),
    )
    blocks = process_sections(documents, kind).withColumn("_blocks", all_blocks)
    text = F.array_join(F.transform("_blocks", lambda b: b["text"]), "\n")
    grounded = blocks.withColumn(
        "markdown", F.when(F.size("sections") > 0, F.concat(head, F.lit("\n"), text))
    )
    done = F.col("markdown").isNotNull()
    return grounded.select(
        "material_id",
        "script",
        F.when(done, "md_ready").otherwise("failed").alias("status"),
        F.when(~done, NO_CONTENT).alias("error_message"),
        F.size("sections").alias("chunk_count"),
        F.aggregate("_blocks", F.lit(0), lambda n, b: n + b["markers"]).alias("marker_count"),
        F.coalesce(F.length("markdown"), F.lit(0)).alias("char_count"),
        grounding.path_segment(F.col("module_code")).alias("module_dir"),
        grounding.markdown_path(
            F.col("module_code"), topic, what, name, F.col("material_id")
        ).alias("md_path"),
        "markdown",
    )
