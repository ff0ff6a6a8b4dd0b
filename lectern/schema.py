"""Fact tables: one definition of every column. ``doc_id`` is in all of them; PDF object keys are structs, null for direct objects."""

from __future__ import annotations

#: ``ancestors`` of an element: the elements it is in, from the root on, itself last. ``table_ord`` of a row: its table, through row groups at any depth.
KEY = "struct<num:int,gen:int>"
BOX = "struct<page:int,x0:double,y0:double,x1:double,y1:double>"

TABLES: dict[str, str] = {
    "docs": f"doc_id bigint, path string, error string, has_struct boolean, lang string, xmp_title string, info_title string, ua_part string, mark_info map<string,boolean>, "
    "display_doc_title boolean, role_map map<string,string>, is_encrypted boolean, encryption_p int, extract_allowed boolean, has_acroform boolean, has_xfa boolean, has_actions boolean, "
    "has_threads boolean, has_oc boolean, has_embedded boolean, outline_count int, n_pages int, oc_configs array<struct<label:string,name:string,has_as:boolean>>, "
    "embedded_files array<struct<f:string,uf:string,desc:string>>",
    "pages": "doc_id bigint, page int, width double, height double, rotate int, tabs string, has_image_xobject boolean, has_form_xobject boolean, parse_error string",
    "elements": "doc_id bigint, ord int, subtree_end int, parent_ord int, logical_parent_ord int, depth int, type_raw string, type string, is_standard boolean, circular boolean, page int, alt string, "
    "actual_text string, lang string, id string, path string, has_p boolean, pg_dangling boolean, has_af boolean, scope string, headers array<string>, colspan int, rowspan int, layout_bbox array<double>, ancestors array<int>, table_ord int",
    "mcrefs": f"doc_id bigint, ord int, seq int, page int, stream {KEY}, mcid int",
    "objrefs": f"doc_id bigint, ord int, seq int, target {KEY}",
    "annotations": f"doc_id bigint, seq int, page int, key {KEY}, subtype string, contents string, flags int, x0 double, y0 double, x1 double, y1 double, field_tu string, field_t string, field_ft string, hidden boolean",
    "runs": f"doc_id bigint, page int, run_seq int, paint_ord int, text string, x0 double, y0 double, x1 double, y1 double, mcid int, stream {KEY}, artifact boolean, tag string, font_key string, size double, render_mode int, in_form boolean",
    "images": f"doc_id bigint, page int, paint_ord int, name string, x0 double, y0 double, x1 double, y1 double, mcid int, stream {KEY}, artifact boolean, width_px int, height_px int, in_form boolean",
    "paths": "doc_id bigint, page int, paint_ord int, x0 double, y0 double, x1 double, y1 double, mcid int, artifact boolean, kind string, stroked boolean, filled boolean",
    "fonts": "doc_id bigint, font_key string, subtype string, base_font string, embedded boolean, has_tounicode boolean, has_encoding boolean, descendant_subtype string, has_cidtogid boolean, indirect boolean, first_page int",
    "font_codes": "doc_id bigint, font_key string, code int, shown boolean, cmap_text string, mapped boolean, notdef boolean",
    "notdefs": "doc_id bigint, page int, font_key string, n int",
    "nesting_events": f"doc_id bigint, page int, seq int, stream {KEY}, mcid int",
    "reference_xobjects": "doc_id bigint, page int, name string, seq int",
    # Optional, from tools this engine doesn't have: words found by another extractor, and grey page images.
    "witness_words": "doc_id bigint, page int, line_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double",
    "rasters": "doc_id bigint, page int, width int, height int, pixels array<smallint>",
    # Which document is compared with which original; both are documents of this store.
    "pairs": "doc_id bigint, source_id bigint",
}

FINDING = f"doc_id bigint, rule string, severity string, message string, page int, location map<string,string>, evidence string, count int, boxes array<{BOX}>"
FINDING_COLUMNS = ["doc_id", "rule", "severity", "message", "page", "location", "evidence", "count", "boxes"]
