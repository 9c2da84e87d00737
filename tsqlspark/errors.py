"""Numbered errors of the dialect."""


class TsqlError(Exception):
    def __init__(self, number: int, message: str):
        super().__init__(f"Msg {number}: {message}")
        self.number = number
        self.message = message
