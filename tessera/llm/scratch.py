"""Tables written between jobs, under the names that this subpackage uses."""

from tessera.sources.rounds import drop_round as discard
from tessera.sources.rounds import keep_round as written
from tessera.sources.rounds import release, rounds

__all__ = ["discard", "release", "rounds", "written"]
