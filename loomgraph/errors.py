"""The one error a caller is meant to see: what is wrong, and what to do about it."""


class ReportError(Exception):
    def __init__(self, message: str, do: str):
        super().__init__(f"{message} {do}")
        self.message, self.do = message, do
