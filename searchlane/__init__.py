"""searchlane: Spark-native data jobs for search-augmented agent training.

Subpackages
-----------
sources    readers / writers and the driver-table fixtures
functions  Column-expression builders (text, actions, array maths)
operators  DataFrame -> DataFrame jobs (retrieval, rollouts, rewards, RL maths, batching)
plans      composed, registered queries (what ``__spark_entry__`` exposes)
streaming  Structured Streaming jobs
"""

from searchlane.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
