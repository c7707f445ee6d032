"""Sales analytics and reconciliation as Spark jobs."""

from salestally.model import SalesModel, bind, bind_folder, to_doubles
from salestally.params import Params
from salestally.session import build_session
from salestally.sources.registry import Registry, default_registry

__all__ = [
    "Params", "Registry", "SalesModel", "bind", "bind_folder", "build_session",
    "default_registry", "to_doubles",
]
