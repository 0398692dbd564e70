"""Issues of pages: an allowlisted public form, reasons, roll-ups by page, and the merge of a final check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Kind, category and reason of known issues; any other has the last one's.
REASONS = (
    ("layout_blocked", "layout_fit", "Translated text did not fit the available frame."),
    ("missing_font_glyph", "font", "No configured font could render the listed characters."),
    ("translated_text_overlap", "layout_overlap", "Translated frames overlap each other."),
    ("local_render_failure", "rendering", "Local text rendering failed; other blocks were retained."),
    ("region_preflight_failed", "rendering", "This region could not be prepared for rendering."),
    ("source_pixels_retained", "content_preservation", "Source pixels were retained because no safe erase geometry was available."),
    ("inserted_text_not_extractable", "text_layer", "The expected character sequence could not be recovered within this target frame."),
    ("original_page_pixels_changed", "graphics", "The copied original page differs from the source at the verification resolution."),
    ("graphics_outside_edit_regions_changed", "graphics", "Pixels changed outside the declared edit regions."),
    ("page_count", "document_structure", "The output page count differs from the requested page count."),
    ("page_dimensions", "document_structure", "The translated page dimensions differ from the source."),
    ("raster_dimensions", "document_structure", "The rendered page dimensions differ from the source."),
    ("missing_translation", "missing_content", "No model translation was available for this target."),
    ("unsupported_text_rotation", "layout_rotation", "This text rotation could not be rendered safely."),
    ("unmatched_emphasis", "text_style", "A source emphasis span could not be placed; base styling was used."),
    ("underline_mapping_unavailable", "text_style", "The partial source underline has no matching translated style target; the source line was retained."),
    ("underline_background_unsafe", "text_style", "The source underline could not be cleared without risking adjacent graphics or a nonuniform background."),
    ("rotated_text", "layout_rotation", "Rotated source text requires a supported local rendering path."),
    ("docling_partial_result", "extraction", "Docling returned an incomplete extraction for this page."),
    ("supplemental_ocr_failed", "extraction", "Supplemental OCR failed on this page."),
    ("ocr_refinement_failed", "extraction", "OCR refinement failed on this page."),
    ("page_enrichment_failed", "extraction", "Native and extracted text could not be fully reconciled on this page."),
    ("page_text_unavailable", "extraction", "No usable text extraction was available for this page."),
)
OTHER = ("processing", "This diagnostic requires review; see its kind and target IDs.")
#: Kinds that a check of the finished pages decides anew.
CHECK_KINDS = ("page_count", "page_dimensions", "raster_dimensions", "original_page_pixels_changed", "graphics_outside_edit_regions_changed", "inserted_text_not_extractable")


def reasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REASONS, "kind string, category string, reason string")


def public(issues: DataFrame) -> DataFrame:
    """Issues with what may be shown: ``kind``, ``phase``, ``region_ids``, ``characters`` and ``reason_code`` by pattern, category and reason by kind."""
    kind = F.when(F.col("kind").rlike(r"\A[a-z][a-z0-9_]*\z"), F.col("kind")).otherwise("unspecified")
    ids = F.filter(F.coalesce("region_ids", F.array()), lambda v: v.rlike(r"\A[A-Za-z0-9_.-]{1,160}\z"))
    own = issues.withColumn("kind", kind).withColumn("phase", F.when(F.col("phase").isin("final", "intermediate"), F.col("phase")).otherwise("final"))
    own = own.withColumn("region_ids", ids).withColumn("characters", F.slice(F.filter("characters", lambda c: F.length(c) == 1), 1, 256))
    own = own.withColumn("reason_code", F.when(F.col("reason_code").rlike(r"\A[a-z][a-z0-9_]{0,120}\z"), F.col("reason_code")))
    own = own.join(F.broadcast(reasons(issues.sparkSession)), "kind", "left")  # a table of this module
    return own.withColumn("category", F.coalesce("category", F.lit(OTHER[0]))).withColumn("reason", F.coalesce("reason", F.lit(OTHER[1])))


def by_page(issues: DataFrame, selected: DataFrame, job: str, page: str, order: str, fields: list[str]) -> DataFrame:
    """Per page its issues, warnings and intermediate ones, each an array of different structs of ``fields`` in their first order.

    ``issues``: job, page, order, phase, warning and the fields. Pages that were not selected, or null, go to the job's row without a page.
    """
    own = issues.join(selected.select(job, page, F.lit(True).alias("__known")), [job, page], "left").withColumn(page, F.when(F.col("__known"), F.col(page)))
    field = F.when(F.col("phase") == "intermediate", "intermediate").when(F.col("warning"), "warnings").otherwise("issues")
    once = own.groupBy(job, page, field.alias("field"), *fields).agg(F.min(order).alias("at"))
    rows = once.groupBy(job, page, "field").agg(F.array_sort(F.collect_list(F.struct("at", F.struct(*fields).alias("x")))).alias("rows"))
    listed = lambda name: F.first(F.when(F.col("field") == name, F.transform("rows", lambda r: r["x"])), ignorenulls=True)
    out = rows.groupBy(job, page).agg(*[listed(n).alias(n) for n in ("issues", "warnings", "intermediate")])
    return out.select(job, page, *[F.coalesce(n, F.array()).alias(n) for n in ("issues", "warnings", "intermediate")])


def merge_checks(issues: DataFrame, final: DataFrame) -> DataFrame:
    """Issues with those of a final check in place of earlier ones of the kinds it decides, which stay as intermediate."""
    old = issues.withColumn("phase", F.when(F.col("kind").isin(*CHECK_KINDS), "intermediate").otherwise(F.col("phase")))
    return old.unionByName(final.withColumn("phase", F.lit("final")))


def unplaced_reasons(unplaced: DataFrame, issues: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Unplaced targets with the number and the first kind of the issues that name them; those that none names stay."""
    named = issues.select(*keys, "kind", F.explode("region_ids").alias(target)).distinct()
    return unplaced.join(named, [*keys, target], "left").groupBy(*keys, target).agg(F.count("kind").alias("reasons"), F.min("kind").alias("first_kind"))


def pixels_changed(pixels: DataFrame, keys: list[str], before: Column, after: Column, masked: Column, level: int = 20, most: int = 6) -> DataFrame:
    """Per page the pixels outside the mask that changed by more than ``level``, and whether these are more than ``most``."""
    out = pixels.groupBy(*keys).agg(F.count_if((F.abs(after - before) > level) & ~masked).alias("changed"))
    return out.withColumn("fails", F.col("changed") > most)


def edge_rounding(pixels: DataFrame, keys: list[str], before: Column, after: Column, at_edge: Column) -> DataFrame:
    """Per page how many pixels changed if all did so by one level, at the outer edge; null for any other change."""
    delta = F.abs(after - before)
    out = pixels.groupBy(*keys).agg(F.max(delta).alias("most"), F.count_if((delta > 0) & ~at_edge).alias("inside"), F.count_if(delta > 0).alias("n"))
    return out.select(*keys, F.when((F.col("most") <= 1) & (F.col("inside") == 0), F.col("n")).alias("edge_pixels"))
