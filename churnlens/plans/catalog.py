"""Import every query module so that each registers its plans."""

from churnlens.plans import clean_queries  # noqa: F401
from churnlens.plans import profile_queries  # noqa: F401
from churnlens.plans import model_prep_queries  # noqa: F401
from churnlens.plans import neighbor_queries  # noqa: F401
from churnlens.plans import model_queries, search_queries  # noqa: F401
from churnlens.plans import edge_queries  # noqa: F401
