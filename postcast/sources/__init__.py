from postcast.sources.tables import read_table  # noqa: F401
from postcast.sources.bindings import stories, comments  # noqa: F401
