"""The odd rows, for tests that need them outside a fixture."""

import importlib.util
import os

_spec = importlib.util.spec_from_file_location("llm_conftest", os.path.join(os.path.dirname(__file__), "conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
odd_rows, prose = _module.odd_rows, _module.prose
