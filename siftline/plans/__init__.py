"""The queries of all operators; later modules add their own to the tables of the first."""

from . import queries as queries  # noqa: I001
from . import evaluation as evaluation
from . import relational as relational
from . import reporting as reporting
from . import orders as orders
from . import search as search
from . import roundtrips as roundtrips
