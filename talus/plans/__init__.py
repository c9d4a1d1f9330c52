"""The plan library: matching, pricing and promoting stored plans."""
