"""Schemas of the knowledge-graph tables, arrays and maps instead of JSON text."""

from __future__ import annotations

_SRC = "module string, file string, line int, seq long"
TABLES: dict[str, str] = {
    "modules": "name string, path string, version string, category string, depends array<string>, auto_install boolean, installable boolean, application boolean, summary string, description string, author string, website string, seq long",
    "models": f"name string, class_name string, inherit_type string, inherits array<string>, inherits_map map<string,string>, description string, table_name string, rec_name string, order_field string, abstract boolean, transient boolean, {_SRC}",
    "fields": f"model string, name string, field_type string, comodel string, label string, required boolean, readonly boolean, store boolean, copy boolean, index boolean, tracking boolean, compute string, inverse string, search string, related string, default_value string, groups string, help string, selection array<struct<key:string,label:string>>, selection_add array<struct<key:string,label:string>>, digits string, ondelete string, domain string, {_SRC}",
    "methods": f"model string, name string, decorators array<string>, depends array<string>, constrains array<string>, onchange array<string>, depends_context array<string>, returns_model string, ormcache_keys array<string>, transitions array<struct<from_state:string,to_state:string,field:string>>, calls_models array<string>, raises_validation boolean, calls_super boolean, body_start int, body_end int, {_SRC}",
    "decorators": f"model string, method string, decorator string, args array<string>, {_SRC}",
    "routes": f"pattern string, patterns array<string>, auth string, type string, methods array<string>, csrf boolean, website boolean, params array<string>, controller string, method string, {_SRC}",
    "views": f"xml_id string, name string, model string, view_type string, inherit_id string, priority int, field_names array<string>, button_names array<string>, view_group string, {_SRC}",
    "elements": f"view_xml_id string, element_type string, field_name string, widget string, button_name string, button_type string, xpath string, position string, groups string, invisible string, attrs string, domain string, {_SRC}",
    "actions": f"xml_id string, action_type string, name string, res_model string, view_mode string, domain string, target string, binding_model string, method string, tag string, report_name string, domain_fields array<string>, {_SRC}",
    "menus": f"xml_id string, name string, parent string, sequence int, action string, groups array<string>, web_icon string, {_SRC}",
    "crons": f"xml_id string, name string, model string, method string, interval_number int, interval_type string, numbercall int, priority int, active boolean, {_SRC}",
    "qweb_templates": f"xml_id string, inherit_id string, is_primary boolean, kind string, t_calls array<string>, t_fields array<string>, t_if_fields array<string>, {_SRC}",
    "mail_templates": f"xml_id string, model string, subject string, refs array<string>, {_SRC}",
    "access_rules": f"xml_id string, name string, model string, group_id string, perm_read boolean, perm_write boolean, perm_create boolean, perm_unlink boolean, {_SRC}",
    "record_rules": f"xml_id string, name string, model string, domain string, groups array<string>, perm_read boolean, perm_write boolean, perm_create boolean, perm_unlink boolean, {_SRC}",
    "js_components": f"kind string, widget string, class_name string, action_tag string, model string, method string, route string, {_SRC}",
    "parse_errors": f"language string, message string, {_SRC}",
}
