"""Schemas of the tables the operators read and write (DDL strings)."""

RULE = ("struct<format:string,size:int,sharpen_pct:int,sharpen_mode:string,gray_a:int,up:int>")

FILES = "path string, modificationTime timestamp, length long, content binary"
CONTAINERS = ("container_id string, kind string, tag string, header_version string, name string, "
              "data_version string, n_parts int, n_bytes long, rc int, reason string")
ASSETS = ("container_id string, asset_id long, ord int, payload_offset long, n_bytes long, fmt string, "
          "width int, height int, dim int")
BINDINGS = ("container_id string, list_no int, ord int, obj_type int, coord_idx int, slot int, "
            "material string, property string, asset_id string")
SHADERS = "container_id string, ord int, obj_type int, slot int, material string, shader string, shader_original string"
PLAN = "class string, ord int, rule " + RULE
OWNER_RULES = "preset_id string, owner_key int, rule " + RULE
PRESET_ASSET_RULES = "preset_id string, rule_no int, asset_id string, sigs array<string>, rule " + RULE

ASSET_KEY = ["container_id", "asset_id"]
