"""A raw tree whose files fail to open for the first times, as a busy store does."""

import os

from gridloom.sources.raw_tree import PruningReader, RawTree


class FlakyReader(PruningReader):
    def load(self, path):
        marks = self.options["marks"]
        name = "_".join(path.split("/")[-3:-1])
        tries = len([f for f in os.listdir(marks) if f.startswith(name)])
        with open(os.path.join(marks, f"{name}.{tries}"), "w"):
            pass
        if tries < int(self.options["faults"]):
            raise OSError(self.options["message"])
        return super().load(path)


class Flaky(RawTree):
    @classmethod
    def name(cls):
        return "flaky_tree"

    def reader(self, schema):
        return FlakyReader(schema, dict(self.options))
