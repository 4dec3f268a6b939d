"""All operators: importing this module registers them."""

from ..operators import bibliography, graph, outline, payload, programme, projections, records, search, store, text, validate, views  # noqa: F401
from ..streaming import refresh  # noqa: F401
from .registry import OPERATORS, SQL, library, queries  # noqa: F401
