"""Where files come from: trees, tables, change sets."""

from .tree import TreeDataSource, list_tree, read_files, read_tree  # noqa: F401
from .tables import from_documents, write_bucketed  # noqa: F401
from .filters import is_ignored, is_source_file, path_order  # noqa: F401
