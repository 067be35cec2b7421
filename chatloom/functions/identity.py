"""Account ids: cleaning, matching, and what kind of session or contact an id is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of ids that the data uses.
OWN_PREFIX = "wxid_"
GROUP_MARK, OFFICIAL_PREFIX, ENTERPRISE_MARK, SERVICE_DESK_MARK = "@chatroom", "gh_", "@openim", "@kefu.openim"
SYSTEM_IDS = ("weixin", "qqmail", "fmessage", "medianote", "floatbottle", "newsapp", "brandsessionholder", "brandservicesessionholder", "notifymessage", "opencustomerservicemsg", "notification_messages", "userexperience_alarm", "helper_folders", "placeholder_foldgroup", "filehelper", "@helper_folders", "@placeholder_foldgroup")
#: Ids that begin with these are the system's.
SYSTEM_HEADS = ("qqmail", "fmessage", "medianote", "floatbottle", "newsapp", "brandsessionholder", "brandservicesessionholder", "notifymessage", "opencustomerservicemsg", "notification_messages", "userexperience_alarm", "helper_folders", "placeholder_foldgroup", "@helper_folders", "@placeholder_foldgroup")
SERVICE_MARK = "service_"
# End of fixed values.


def clean_id(raw: Column) -> Column:
    """Own-prefix ids lose what follows their second underscore; others a suffix of ``_`` and four letters or digits."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    own = F.regexp_extract(t, f"(?i)^({OWN_PREFIX}[^_]+)", 1)
    other = F.regexp_extract(t, "^(.+)_([a-zA-Z0-9]{4})$", 1)
    return F.when(F.startswith(F.lower(t), F.lit(OWN_PREFIX)) & (own != ""), own).when(other != "", other).otherwise(t)


def identity_keys(raw: Column) -> Column:
    """Lower-cased cleaned and raw id, without repeats and empties."""
    return F.array_remove(F.array_distinct(F.array(F.lower(clean_id(raw)), F.lower(F.trim(F.coalesce(raw, F.lit("")))))), "")


def same_account(left: Column, right: Column) -> Column:
    """Keys of both are equal, or one is the other with a tail behind ``_``."""

    def alike(a: Column, b: Column) -> Column:
        return (a == b) | F.startswith(a, F.concat(b, F.lit("_"))) | F.startswith(b, F.concat(a, F.lit("_")))

    return F.exists(identity_keys(left), lambda a: F.exists(identity_keys(right), lambda b: alike(a, b)))


def sent_by_me(is_send: Column, sender: Column, me: str) -> Column:
    """A matching sender or the flag; the sender goes first where it is known."""
    mine = same_account(sender, F.lit(me))
    flag = F.lower(F.coalesce(is_send.cast("string"), F.lit(""))).isin("1", "true")
    return F.coalesce(mine, F.lit(False)) | flag


def sent_by_me_explicit(is_send: Column, sender: Column, me: str) -> Column:
    """An explicit flag decides; only without one does the sender."""
    flag = F.lower(is_send.cast("string"))
    return F.when(flag.isin("1", "true"), True).when(flag.isin("0", "false"), False).otherwise(F.coalesce(F.lower(sender) == me.lower(), F.lit(False)))


def is_group(username: Column) -> Column:
    return F.contains(F.coalesce(username, F.lit("")), F.lit(GROUP_MARK))


def is_enterprise(username: Column) -> Column:
    return F.contains(username, F.lit(ENTERPRISE_MARK)) & ~F.contains(username, F.lit(SERVICE_DESK_MARK))


def is_private(username: Column, me: str = "") -> Column:
    """No group, official or enterprise account, service, system id or oneself. Ids are compared as they are, two of them in any case."""
    u = F.trim(F.coalesce(username, F.lit("")))
    system = F.lower(u).isin("weixin") | (u == "filehelper")
    for head in SYSTEM_HEADS:
        system |= F.startswith(u, F.lit(head))
    other = F.startswith(u, F.lit(OFFICIAL_PREFIX)) | F.contains(u, F.lit(ENTERPRISE_MARK)) | F.contains(u, F.lit(SERVICE_DESK_MARK)) | F.contains(u, F.lit(SERVICE_MARK))
    return (u != "") & ~is_group(u) & ~system & ~other & (F.lit(True) if not me else F.lower(u) != F.lower(clean_id(F.lit(me))))


def keeps_session(username: Column, local_type: Column) -> Column:
    """Groups stay; placeholders, official and system ids go; enterprise ids stay as contacts of type 5."""
    u = F.lower(F.coalesce(username, F.lit("")))
    return F.when(is_group(u), True).when(F.contains(u, F.lit("placeholder")) | F.startswith(u, F.lit(OFFICIAL_PREFIX)) | u.isin(*SYSTEM_IDS), False).when(is_enterprise(u), F.coalesce(local_type == 5, F.lit(False))).otherwise(u != "")


def session_kind(username: Column) -> Column:
    u = F.coalesce(username, F.lit(""))
    return F.when(is_group(u), "group").when(F.startswith(u, F.lit(OFFICIAL_PREFIX)), "channel").when(is_private(u), "private").otherwise("other")


def contact_type(username: Column, local_type: Column, flag: Column, quan_pin: Column) -> Column:
    """group, official, blocked, former_friend, friend or other, the first that fits."""
    u = F.coalesce(username, F.lit(""))
    return (
        F.when(is_group(u), "group").when(F.startswith(u, F.lit(OFFICIAL_PREFIX)), "official")
        .when(F.coalesce(flag, F.lit(0)).bitwiseAND(8) != 0, "blocked")
        .when((local_type == 0) & (F.coalesce(quan_pin, F.lit("")) != ""), "former_friend")
        .when((local_type == 1) & ~u.isin(*SYSTEM_IDS), "friend").otherwise("other")
    )


def official_kind(kind: Column) -> Column:
    return F.when(kind == 0, "subscription").when(kind == 1, "service").when(kind.isin(2, 3), "enterprise").otherwise("unknown")


def display_name(remark: Column, nick_name: Column, alias: Column, username: Column) -> Column:
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(filled(remark), filled(nick_name), filled(alias), username)
