"""What the driver-side calls raise. Column operators return null and an error text instead."""


class TessellaError(Exception):
    pass


class UnsupportedModelError(TessellaError):
    pass


class ConversionError(TessellaError):
    pass


class ValidationError(TessellaError):
    pass


class AdapterParseError(TessellaError):
    pass
