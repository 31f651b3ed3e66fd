"""Select lists as trees of fields and relations."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from ..errors import FieldNotFound
from ..sources.catalog import Catalog, Entity, Relation

logger = logging.getLogger("plumbline")
ROOT = "$"


@dataclass
class Node:
    """An entity at a place of the query, with the fields and the relations that are selected there."""

    entity: Entity
    steps: tuple[str, ...] = ()
    relation: Relation | None = None
    fields: list[str] = field(default_factory=list)
    children: dict[str, Node] = field(default_factory=dict)

    @property
    def path(self) -> str:
        return ".".join(self.steps) or ROOT

    def column(self, name: str) -> str:
        return f"{self.path}.{name}"

    def walk(self) -> Iterator[Node]:
        """This node and all below, parents first."""
        yield self
        for child in self.children.values():
            yield from child.walk()

    def at(self, steps: tuple[str, ...]) -> Node | None:
        node: Node | None = self
        for step in steps:
            node = node.children.get(step) if node else None
        return node


def _items(fields: list[Any]) -> Iterator[tuple[str, list[Any] | None]]:
    for item in fields:
        if isinstance(item, dict):
            yield from item.items()
        else:
            yield item, None


def tree(catalog: Catalog, entity: Entity, fields: list[Any] | None, steps: tuple[str, ...] = (), relation: Relation | None = None) -> Node:
    """Fields in their order, each once; ``*`` stands for all, by name, in place of those before it. Without any at the root: all.

    An unknown field raises FieldNotFound; an unknown relation is left out with a warning."""
    node, known = Node(entity, steps, relation), catalog.fields(entity)
    for name, inner in _items(fields or []):
        if inner is not None:
            if name not in entity.relations:
                logger.warning("Relation %s not found in %s", name, entity.name)
                continue
            link, target = catalog.related(entity, name)
            child = tree(catalog, target, inner, (*steps, name), link)
            if name in node.children:  # a relation named twice: its fields together
                merged = node.children[name]
                merged.fields += [f for f in child.fields if f not in merged.fields]
                merged.children |= child.children
            else:
                node.children[name] = child
        elif name == "*":
            node.fields = sorted(known)
        elif name not in known:
            logger.warning("Field %s not found in %s", name, entity.name)
            raise FieldNotFound(f"Field {name} not found in {entity.name}")
        elif name not in node.fields:
            node.fields.append(name)
    if not steps and not fields:
        node.fields = list(known)
    return node
