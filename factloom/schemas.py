"""Fixed schemas and names of the evidence model."""

from __future__ import annotations

VALUE = (
    "struct<kind:string,amount:double,currency:string,qty:double,unit:string,per_value:double,per_unit:string,"
    "text:string,name:string,address:string>"
)
POINT_RING = "struct<type:string,points:array<struct<x:double,y:double>>,space:string>"
#: Fixed values of the contract, in its order: field -> (block, key) of the projection.
PROJECTION = {
    "commodity.name": ("commodity", "name"),
    "commodity.classification": ("commodity", "classification"),
    "package.is_prepackaged": ("package", "is_prepackaged"),
    "package.package_type": ("package", "package_type"),
    "package.net_quantity": ("package", "net_quantity"),
    "package.mrp": ("package", "mrp"),
    "package.unit_sale_price": ("package", "unit_sale_price"),
    "package.dimensions": ("package", "dimensions"),
    "declarations.manufacturer": ("declarations", "manufacturer"),
    "declarations.packer": ("declarations", "packer"),
    "declarations.importer": ("declarations", "importer"),
    "declarations.country_of_origin": ("declarations", "country_of_origin"),
    "declarations.generic_name": ("declarations", "generic_name"),
    "declarations.manufacture_date": ("declarations", "manufacture_date"),
    "declarations.best_before": ("declarations", "best_before"),
    "declarations.consumer_care": ("declarations", "consumer_care"),
}
#: Fields that are resolved for diagnostics and not projected.
INTERNAL_FIELDS = ("presentation.letter_height_mm", "presentation.principal_display_panel_area_mm2")
#: Fields that recognised lines can settle.
RESOLVED_FIELDS = tuple(f for f in PROJECTION if f.split(".")[1] not in ("name", "classification", "is_prepackaged", "package_type", "dimensions"))
DATE_FIELDS = ("declarations.manufacture_date", "declarations.best_before")
PARTY_FIELDS = ("declarations.manufacturer", "declarations.packer", "declarations.importer")
SNAPSHOT_VERSION = "package-facts/1.1"
VALUE_STATUSES = ("OBSERVED", "DERIVED")
CONTRACT_STATUSES = ("OBSERVED", "DERIVED", "UNKNOWN", "DECLARED_ABSENCE", "CONFLICTING")
