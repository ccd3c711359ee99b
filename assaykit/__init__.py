"""Evidence analytics on Spark: documents checked against themselves, their bibliographies and their code.

``check`` runs the rules over facts of papers; ``read_papers`` gives the facts; ``rule`` registers a rule of one's own. The queries and operators are in
the subpackages."""

__version__ = "0.2.0"
__all__ = ["check", "read_papers", "rule"]


def __getattr__(name: str):
    """What is named here is imported on first use, as Spark takes its time."""
    from importlib import import_module

    homes = {"check": ("assaykit.plans.engine", "run"), "read_papers": ("assaykit.sources.papers", "read_papers"), "rule": ("assaykit.plans.rules", "rule")}
    if name not in homes:
        raise AttributeError(name)
    module, own = homes[name]
    return getattr(import_module(module), own)
