import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

from llm_conftest import mixed_docs  # noqa: E402, F401
