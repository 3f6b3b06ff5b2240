"""Payloads of the capture contract as JSON columns: session, image entry and metadata bundle.

Keys that have no value are written as null, as receivers tell a missing answer from a missing key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T

#: Fixed values of the contract.
INPUT_VERSION = "lm-capture-input/1.1"
BUNDLE_VERSION = "lm-capture-metadata/1.1"
IDENTIFICATION_NOTE = "Identifies the product only. This is not evidence that any declaration is present or compliant."
FLAGS = ("sale_channel", "is_imported", "is_for_retail", "is_ecommerce_listing")


def session_id(product_id: Column) -> Column:
    return F.concat(F.lit("CS-"), product_id)


def package_id(product_id: Column) -> Column:
    return F.concat(F.lit("PKG-"), product_id)


def artifact_id(capture_id: Column) -> Column:
    return F.concat(F.lit("IMG-"), capture_id)


def iso(time: Column) -> Column:
    """A UTC time as ISO text."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def as_json(body: Column) -> Column:
    return F.to_json(body, {"ignoreNullFields": "false"})


def declared(context: Column) -> Column:
    """Whether every applicability flag has an answer; false is one."""
    answered = F.lit(True)
    for flag in FLAGS:
        answered = answered & context[flag].isNotNull()
    return answered


def _jurisdiction(context: Column) -> Column:
    return F.struct(F.coalesce(context["country"], F.lit("IN")).alias("country"), context["state"].alias("state"))


def session_payloads(products: DataFrame) -> DataFrame:
    """(product_id, payload): what opens a product's session; null while a flag of its context is unanswered.

    products: product_id, started_at, client (platform, app_version, device_model), context (country,
    state and ``FLAGS``).
    """
    context = F.struct(_jurisdiction(F.col("context")).alias("jurisdiction"), *[F.col("context")[f].alias(f) for f in FLAGS])
    body = F.struct(
        F.lit(INPUT_VERSION).alias("schema_version"), session_id(F.col("product_id")).alias("capture_session_id"), package_id(F.col("product_id")).alias("package_id"),
        F.col("client"), context.alias("context"), iso(F.col("started_at")).alias("started_at"),
    )
    return products.select("product_id", F.when(declared(F.col("context")), as_json(body)).alias("payload"))


def _first_tag(exif: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_element_at(exif, F.lit(n)) for n in names])


def image_entry(sequence_index: Column) -> Column:
    """An accepted capture as an entry of its job; sizes are the sensor's, not those of the analysed picture.

    Reads capture_id, sha256, captured_at, source_width, source_height and exif.
    """
    exif = F.col("exif")
    described = F.struct(
        F.col("source_width").alias("width_px"), F.col("source_height").alias("height_px"), T.exif_rational(_first_tag(exif, "EXIF FocalLength", "FocalLength")).alias("focal_length_mm"),
        T.exif_orientation(_first_tag(exif, "Image Orientation", "EXIF Orientation", "Orientation")).alias("orientation"),
    )
    return F.struct(
        artifact_id(F.col("capture_id")).alias("artifact_id"), F.col("sha256"), F.lit(None).cast("string").alias("uri"), sequence_index.alias("sequence_index"),
        iso(F.col("captured_at")).alias("captured_at"), described.alias("capture_metadata"),
    )


def bundles(captures: DataFrame, products: DataFrame, inspections: DataFrame, attempts: DataFrame) -> DataFrame:
    """(capture_id, payload): everything about one capture that an upload carries, sufficient on its own.

    captures: capture_id, inspection_id, product_id, surface_id, surface_label, attempt_number, disposition,
    needs_review, review_reason, captured_at, device_id, device_model, os_version, size_bytes, sha256,
    camera, exif (maps) and quality (a struct). products: product_id, product_label, started_at, required,
    resolved, complete, context, identification (a struct or null). inspections: inspection_id,
    premises_label, inspector_reference, started_at. attempts: product_id, surface_id, total.
    """
    p = products.select(
        "product_id", "product_label", F.col("started_at").alias("product_started"), "required", "resolved", "complete", "context", F.col("identification").alias("identified")
    )
    i = inspections.select("inspection_id", "premises_label", "inspector_reference", F.col("started_at").alias("inspection_started"))
    c = captures.join(p, "product_id").join(i, "inspection_id").join(attempts.select("product_id", "surface_id", "total"), ["product_id", "surface_id"], "left")
    ids = F.struct(
        F.col("inspection_id").alias("inspectionId"), F.col("product_id").alias("productSessionId"), F.col("capture_id").alias("captureId"), session_id(F.col("product_id")).alias("captureSessionId"),
        package_id(F.col("product_id")).alias("packageId"), artifact_id(F.col("capture_id")).alias("artifactId"), F.lit("uuid-v4-client-generated").alias("scheme"), F.lit(True).alias("serverMustPreserveClientIds"),
    )
    covered = F.struct(
        F.col("required").alias("requiredSteps"), F.col("resolved").alias("resolvedSteps"), F.format_string("%d of %d captured", "resolved", "required").alias("label"), F.col("complete")
    )
    context = F.col("context")
    stated = F.struct(
        _jurisdiction(context).alias("jurisdiction"), context["sale_channel"].alias("saleChannel"), context["is_imported"].alias("isImported"), context["is_for_retail"].alias("isForRetail"),
        context["is_ecommerce_listing"].alias("isEcommerceListing"), declared(context).alias("complete"),
    )
    known = next(f.dataType for f in products.schema if f.name == "identification").fieldNames()
    identified = F.struct(*[F.col("identified")[k].alias(k) for k in known], F.lit(IDENTIFICATION_NOTE).alias("note"))
    body = F.struct(
        F.lit(BUNDLE_VERSION).alias("schemaVersion"), ids.alias("ids"),
        F.struct(F.col("inspection_id").alias("inspectionId"), F.col("premises_label").alias("premisesLabel"), F.col("inspector_reference").alias("inspectorReference"), iso(F.col("inspection_started")).alias("startedAtUtc")).alias("inspection"),
        F.struct(F.col("product_id").alias("productSessionId"), F.col("product_label").alias("productLabel"), iso(F.col("product_started")).alias("startedAtUtc"), covered.alias("coverage")).alias("productSession"),
        stated.alias("context"),
        F.struct(
            F.col("surface_id").alias("surfaceId"), F.col("surface_label").alias("surfaceLabel"), F.col("attempt_number").alias("attemptNumber"), F.coalesce("total", F.lit(0)).cast("long").alias("totalAttempts"),
            F.col("disposition"), F.col("needs_review").alias("manualReviewRequired"), F.when(F.col("needs_review"), F.col("review_reason")).alias("manualReviewReason"),
        ).alias("surface"),
        iso(F.col("captured_at")).alias("capturedAtUtc"), F.struct(F.col("device_id").alias("deviceId"), F.col("device_model").alias("model"), F.col("os_version").alias("osVersion")).alias("device"),
        F.struct(
            F.concat("capture_id", F.lit(".jpg")).alias("fileName"), F.lit("image/jpeg").alias("mimeType"), F.col("size_bytes").alias("sizeBytes"), F.col("sha256"), F.lit(False).alias("re_encoded"), F.lit(True).alias("exifPreserved")
        ).alias("file"),
        F.col("camera").alias("cameraSettings"), F.col("exif"), F.col("quality"), F.when(F.col("identified").isNotNull(), identified).alias("identification"),
    )
    return c.select("capture_id", as_json(body).alias("payload"))
