"""All queries of this subpackage and their SQL."""

from topoweave.llm import docpairs_queries as _p4
from topoweave.llm import leakage_queries as _p7
from topoweave.llm import setjoin_queries as _p3
from topoweave.llm import nearcopies_queries as _p5
from topoweave.llm import neighbours_queries as _p2
from topoweave.llm import packing_queries as _p6
from topoweave.llm import reading_queries as _p8

_PARTS = [_p2, _p3, _p4, _p5, _p6, _p7, _p8]
QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
SQL = {k: s for m in _PARTS for k, s in m.SQL.items()}
