"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontam, lang_id, license_scan, packing, quality, sharding, simhash, sketch, url_filter, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_language_id": lang_id.op3_language_id,
    "op4_packing": packing.op4_packing,
    "op5_warc": warc.op5_warc,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_sharding": sharding.op8_sharding,
    "op9_fingerprint": sketch.op9_fingerprint,
    "op10_quality": quality.op10_quality,
}

SQL = {
    "op1_license_scan": license_scan.SQL,
    "op2_url_filter": url_filter.SQL,
    "op5_warc": warc.SQL,
    "op7_decontamination": decontam.SQL,
}
