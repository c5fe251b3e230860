"""Column and DataFrame helpers shared by the operators."""
from stallkeeper.functions.core import *  # noqa: F401,F403
