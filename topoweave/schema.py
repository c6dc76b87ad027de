"""Columns of the property graph: typed symbols and typed relationships.

The enumerations and zoom levels are fixed values of the data model.
"""

SYMBOL_TYPES = ["module", "class", "function", "method", "variable", "parameter"]
EDGE_TYPES = ["calls", "imports", "inherits", "reads", "writes", "contains", "proposed", "returns"]

#: Symbol types shown at each zoom level.
ZOOM = {
    "module": ["module"],
    "class": ["class"],
    "function": ["function", "method"],
    "variable": ["variable", "parameter"],
    "all": SYMBOL_TYPES,
}

NODE_COLUMNS = ["id", "name", "qualified_name", "symbol_type", "file_path", "line_start", "line_end", "docstring", "signature", "is_dead", "is_proposed", "metadata"]
EDGE_COLUMNS = ["source", "target", "edge_type", "is_dead", "is_proposed", "line", "metadata", "seq"]
